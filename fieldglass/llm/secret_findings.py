"""Labelled findings written apart from those the network is trained on: other formats, other alphabets, other surroundings.

They set the threshold of :mod:`.secret_scan`, and its tests measure recall by kind and false alarms on them.
"""

from __future__ import annotations

import numpy as np

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
MIXED, SIGNS = LOWER + UPPER + DIGITS, "!#$%&*?^~@"
WORDS = ("deploy", "please", "rotate", "the", "server", "before", "monday", "see", "notes", "below", "and", "restart", "worker", "with", "new", "values", "thanks", "team", "config", "file")


class Writer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def run(self, alphabet: str, lo: int, hi: int | None = None) -> str:
        return "".join(self.rng.choice(list(alphabet), self.rng.integers(lo, (hi or lo) + 1)))

    def pick(self, *options: str) -> str:
        return str(self.rng.choice(options))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.rng.choice(WORDS, self.rng.integers(lo, hi + 1)))

    def signed(self, lo: int, hi: int) -> str:
        """Letters, digits and at least two signs, a sign never first."""
        body = list(self.run(MIXED, lo, hi))
        for at in self.rng.choice(np.arange(2, len(body) - 1), 2, replace=False):
            body[at] = str(self.rng.choice(list(SIGNS)))
        return "".join(body)

    def uuid(self) -> str:
        return "-".join(self.run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))


def secrets(w: Writer) -> dict[str, tuple[str, str, str]]:
    """kind -> (what stands before, the secret, what stands after), newly drawn."""
    quote = w.pick('"', "'")
    return {
        "channel token": (w.pick("hook uses ", "SLACK=", ""), f"xox{w.pick('b', 'p', 'a')}-{w.run(DIGITS, 10, 13)}-{w.run(DIGITS, 10, 13)}-{w.run(MIXED, 20, 26)}", w.pick("", "\n", " ")),
        "password in JSON": ('{"user": "' + w.run(LOWER, 4, 8) + '", "' + w.pick("password", "passwd", "pass") + '": "', w.run(MIXED, 12, 16), '"}'),
        "connection string": (w.pick("postgres", "mysql", "amqp", "redis", "mongodb") + "://" + w.run(LOWER, 4, 8) + ":", w.run(MIXED, 12, 20), "@" + w.run(LOWER, 3, 8) + ".internal:" + w.run(DIGITS, 4) + "/app"),
        "short assignment": (w.pick("pwd=", "PWD: ", "passwd=", "DB_PASS="), w.run(MIXED, 10, 12), w.pick("\n", " ", ";")),
        "password with signs": (w.pick("password = ", "passwd: ", "secret=") + quote, w.signed(12, 18), quote),
        "client secret": (w.pick("client_secret=", "client_secret: ", '"client_secret": "'), w.uuid(), w.pick('"', "\n", "&")),
        "service key": (w.pick("STRIPE=", "key ", "export K="), w.pick("sk_live_", "rk_live_", "SG.", "AIza", "dop_v1_", "hf_", "github_pat_") + w.run(MIXED, 24, 36), w.pick("", "\n", " ;")),
        "bearer": ("Authorization: Bearer ", w.run(MIXED + "-_", 28, 44), w.pick("\r\n", "'")),
        "web token": (w.pick("jwt ", "id_token=", "cookie: t="), f"eyJ{w.run(MIXED, 17, 30)}.eyJ{w.run(MIXED, 30, 60)}.{w.run(MIXED + '_-', 43)}", w.pick("", ";", "\n")),
    }


def look_alikes(w: Writer) -> dict[str, tuple[str, str, str]]:
    return {
        "image data": (w.pick("src='", 'url("'), "data:image/" + w.pick("png", "jpeg", "gif") + ";base64," + w.pick("iVBORw0KGgo", "/9j/4AAQSk", "R0lGODlh") + w.run(MIXED + "+/", 60, 300), w.pick("'", '")')),
        "identifier": (w.pick("order ", "id=", "trace ", "urn:uuid:"), w.uuid(), w.pick("", ",", "\n")),
        "address of a page": (w.pick("see ", "", "<"), "https://" + w.run(LOWER, 4, 9) + ".example.com/" + "/".join(w.rng.choice(WORDS, 3)) + "?page=" + w.run(DIGITS, 1, 3), w.pick("", ">", ".")),
        "host with a port": (w.pick("amqp://", "http://", "at "), w.run(LOWER, 4, 9) + "." + w.run(LOWER, 3, 7) + ".internal:" + w.run(DIGITS, 4), "/" + w.run(LOWER, 3, 6)),
        "time": (w.pick("at ", "[", ""), f"20{w.run(DIGITS, 2)}-1{w.run('012', 1)}-0{w.run('123456789', 1)}T1{w.run(DIGITS, 1)}:3{w.run(DIGITS, 1)}:2{w.run(DIGITS, 1)}.{w.run(DIGITS, 3)}Z", w.pick("", "]")),
        "word after a name": (w.pick("password: ", "token = ", "secret: ", "pwd: "), w.pick("required", "optional", "undefined", "environment", "placeholder", "<your-password>", "${DB_PASSWORD}", "********", "changed-yesterday"), w.pick("\n", " ", ".")),
        "package": (w.pick("npm i ", "version ", "jar "), "-".join(w.rng.choice(WORDS, 3)) + "-" + ".".join(w.run(DIGITS, 1, 2) for _ in range(3)) + w.pick("", ".jar", "-SNAPSHOT"), w.pick("", "\n")),
        "called function": (w.pick("", "self.", "return "), "_".join(w.rng.choice(WORDS, 3)) + "." + "_".join(w.rng.choice(WORDS, 2)), "()"),
        "path": (w.pick("in ", "", "cp "), "/" + "/".join(w.rng.choice(WORDS, 5)) + w.pick(".py", ".txt", "/"), w.pick(" ", "\n")),
        "number": (w.pick("tel ", "iban ", "no. "), w.run(DIGITS, 12, 20), w.pick("", "\n")),
    }


def drawn(n: int, seed: int) -> list[tuple[str, int, int, int, str]]:
    """(text, start, end, 1 for a secret, kind): as many of each kind."""
    w, out = Writer(seed), []
    kinds = [(k, 1) for k in secrets(w)] + [(k, 0) for k in look_alikes(w)]
    for i in range(n):
        kind, label = kinds[i % len(kinds)]
        lead, body, after = (secrets if label else look_alikes)(w)[kind]
        head = w.words(0, 8)
        head += w.pick(" ", "\n") * bool(head) + lead
        out.append((head + body + after + w.pick(" ", "\n") + w.words(0, 8), len(head), len(head) + len(body), label, kind))
    return out
