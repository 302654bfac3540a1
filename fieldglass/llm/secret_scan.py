"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

A candidate is a whole run of secret characters, at least ``LEAST`` long, within the patterns' spans or not, or the whole
value, of any visible characters from eight on, of what is named like a secret or stands as the password of an address. The network sees 64 of its characters and
32 on each side, with filters pooled apart over candidate and context; a longer candidate is seen in windows that
overlap by half, and the largest logit counts, in training as in scans. It is
trained on labelled findings: texts written by ``findings()`` from formats of keys, passwords and tokens,
and of things that look like them (addresses, hosts, numbers, versions, paths, dates, identifiers,
long words in any case and prose, rules, checksums named as such). Its logit is calibrated on findings kept apart, and the threshold is the highest
at which recall on them is at least ``RECALL``, and on each kind of :mod:`.secret_findings`, which are written apart
from these, at least ``KIND_RECALL``; recall is of the secrets in whole texts, so one that the search for
candidates does not give counts as missed. The patterns' spans stay whatever the network says of them;
it adds spans, of kind ``model``, where a candidate is not wholly inside them already.

Nulls count as empty texts, without spans. A null id is carried; repeated rows are scanned each. Texts of
any length are scanned whole. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import secret_findings
from .common import require
from .convnet import Net, sigmoid

#: The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run is dropped whole, so the least length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

KINDS = ("assign", "access", "hex", "model")
LEAST, SIDE, BODY = 12, 32, 64
SECRET = "A-Za-z0-9+/_.=-"
CANDIDATE = re.compile(rf"[{SECRET}]{{{LEAST},}}")
#: Values of any visible characters after a name of a secret, and between the colon and the at sign of an address.
NAMED = re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api_?key|access_?key)["']?\x20*[:=]\x20*(?:"([^"\s]{8,})"|'([^'\s]{8,})'|([^\s"',;&]{8,}))""", re.IGNORECASE | re.ASCII)
LOGIN = re.compile(r"://[^\s:/@]{1,64}:([^\s@/]{8,})@")
#: From a data address to the end of its base64.
EMBEDDED = re.compile(r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]*")
WIDTH = 2 * SIDE + BODY
KERNEL, STRIDE = 5, 1
RECALL, KIND_RECALL, FINDINGS, APART, EPOCHS, SEED = 0.95, 0.94, 16000, 3800, 5, 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans to score: whole runs and whole values, united where they overlap; embedded files are none."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    found += [m.span(m.lastindex) for m in NAMED.finditer(text)] + [m.span(1) for m in LOGIN.finditer(text)]
    embedded = [m.span() for m in EMBEDDED.finditer(text)]
    out: list[tuple[int, int]] = []
    at = 0
    for s, e in sorted(set(found), key=lambda x: (x[0], -x[1])):
        while at < len(embedded) and embedded[at][1] <= s:
            at += 1
        if at < len(embedded) and embedded[at][0] < e:
            continue
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def covered(start: int, end: int, taken: list[tuple[int, int, int]]) -> bool:
    """Whether the sorted spans of ``taken`` together hold every character from ``start`` to ``end``."""
    for s, _, e in taken:
        if s > start:
            return False
        if e > start:
            start = e
        if start >= end:
            return True
    return False


def window(text: str, start: int, end: int) -> tuple[bytes, int]:
    """Bytes of a whole candidate in its context, and its length."""
    left, right = text[max(0, start - SIDE) : start], text[end : end + SIDE]
    line = left.rjust(SIDE, "\0") + text[start:end] + right.ljust(SIDE, "\0")
    return line.encode("latin-1", "replace"), end - start


def parts(line: bytes, length: int) -> list[tuple[bytes, int]]:
    """Fixed-width windows over a candidate that overlap by half, the last one at its end; one for a short candidate."""
    last = max(0, length - BODY)
    at = [*range(0, last, BODY // 2), last]
    return [(line[o : o + WIDTH].ljust(WIDTH, b"\0"), min(BODY, length)) for o in at]


class Scanner:
    def __init__(self, net: Net, scale: tuple[float, float], threshold: float):
        self.net, self.scale, self.threshold = net, scale, threshold

    def logits(self, windows: list[tuple[bytes, int]]) -> np.ndarray:
        """The largest logit over the parts of each window."""
        cut = [parts(*w) for w in windows]
        flat, out = [p for ps in cut for p in ps], []
        for at in range(0, len(flat), 1024):
            x, masks = arrays(flat[at : at + 1024])
            out.append(self.net.head(np.hstack([p for p, _ in self.net.pool(x, masks)]).astype(np.float32))[1])
        first = np.cumsum([0, *(len(ps) for ps in cut)])[:-1]
        return np.maximum.reduceat(np.concatenate(out), first) if out else np.zeros(0, np.float32)

    def probabilities(self, windows: list[tuple[bytes, int]]) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(windows) + self.scale[1])

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, kind number, end) of each text, sorted."""
        spans = [base_spans(t) for t in texts]
        found = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
        added: list[list] = [[] for _ in texts]
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            p = self.probabilities([window(texts[i], s, e) for i, s, e in part])
            for (i, s, e), ok in zip(part, p >= self.threshold):
                if ok and not covered(s, e, spans[i]):
                    added[i].append((s, 3, e))
        return [sorted(s + m) for s, m in zip(spans, added)]


def arrays(windows: list[tuple[bytes, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    x = np.frombuffer(b"".join(w for w, _ in windows), np.uint8).reshape(-1, WIDTH)
    middle = np.arange((WIDTH - KERNEL) // STRIDE + 1) * STRIDE + KERNEL // 2
    inside = (middle >= SIDE) & (middle < SIDE + np.array([n for _, n in windows])[:, None])
    return x, [inside, ~inside]


#: Parts of long ordinary words, and short words.
HEADS = ("inter", "counter", "trans", "under", "over", "electro", "dis", "re", "un", "multi", "mis", "super", "photo", "micro", "con", "pre", "in", "sub")
STEMS = ("nation", "govern", "communic", "present", "organ", "respons", "charact", "develop", "establish", "administr", "struct", "form", "particip", "consider", "form", "product", "ident", "know", "standard", "collect")
TAILS = ("ization", "ational", "ically", "mentally", "ativeness", "ibility", "eristic", "ments", "ational", "edness", "ification", "ingly", "istration", "iveness")
COMMON = ("time", "people", "water", "house", "correct", "horse", "battery", "staple", "river", "garden", "winter", "yellow", "market", "window", "letter", "summer", "orange", "silver", "master", "dragon", "monkey", "simple", "config", "source", "server", "client", "handler", "factory", "manager", "local", "share", "user", "main", "test", "data", "docs", "lib", "usr", "home", "build")


#: Syllables of invented words, so that prose of no known language is among the look-alikes.
SYLLABLES = tuple(a + v + b for a in ("", "b", "c", "d", "f", "g", "h", "j", "k", "l", "ll", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "wh", "st", "th", "ch", "sch", "tr", "pr", "br") for v in ("a", "e", "i", "o", "u", "ou", "ei", "ie", "ea", "au", "io") for b in ("", "", "n", "r", "s", "t", "l", "nd", "nt", "ng", "ch", "x"))


def findings(n: int, seed: int = SEED) -> list[tuple[str, int, int, int, str]]:
    """Labelled findings (text, start, end, 1 for a secret, kind): keys and look-alikes set in prose, shouting, code and settings."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits

    def run(alphabet: str, lo: int, hi: int | None = None) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(lo, (hi or lo) + 1)))

    def pick(*options: str) -> str:
        return str(rng.choice(list(options)))

    def word() -> str:
        return run(lower, 2, 9)

    def babble(k: int) -> str:
        return "".join(SYLLABLES[i] for i in rng.integers(len(SYLLABLES), size=k))

    def prose(k: int) -> str:
        words = [word() if rng.random() < 0.5 else babble(int(rng.integers(1, 5))) for _ in range(k)]
        style = rng.random()
        if style < 0.15:
            return " ".join(w.upper() + "!!" * (rng.random() < 0.6) for w in words)
        return " ".join(w + str(rng.choice(("", "", "", ",", "."))) for w in words) if style < 0.5 else " ".join(words)

    def cased(w: str) -> str:
        return (w, w.capitalize(), w.upper())[rng.integers(3)]

    def number(lo: int, hi: int) -> str:
        return str(rng.integers(lo, hi))

    phrases: set[str] = set()

    def title() -> str:
        return long_word().capitalize() if rng.random() < 0.3 else str(rng.choice(COMMON)).capitalize()

    def phrase() -> str:
        body = pick("", "-").join(str(rng.choice(COMMON)).capitalize() for _ in range(rng.integers(3, 6)))
        phrases.add(body)
        return body

    def long_word() -> str:
        return pick(*HEADS) + pick(*STEMS) + pick(*TAILS)

    def segment() -> str:
        return [word, long_word, lambda: str(rng.choice(COMMON)), lambda: word() + pick("-", "_", ".") + number(1, 99)][rng.integers(4)]()

    def path(k: int) -> str:
        return "/".join(segment() for _ in range(k))

    def within() -> str:
        """A token in the middle of a longer run."""
        token = pick("ghp_", "gho_", "sk-", "glpat-", "npm_", "") + run(lower + upper + digits, 24, 36)
        return pick("/", "", "//") + path(int(rng.integers(2, 8))) + pick("/", "/key=", "=") + token + "/" + path(int(rng.integers(2, 8)))

    mixed = lower + upper + digits
    secrets = {
        "random": lambda: run(mixed, 20, 44),
        "base64": lambda: run(mixed + "+/", 30, 64) + pick("", "=", "=="),
        "prefixed": lambda: pick("ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "npm_", "pk_", "key-") + run(mixed, 16, 40),
        "web token": lambda: "eyJ" + run(mixed, 15, 30) + "." + run(mixed + "_-", 20, 60) + "." + run(mixed + "_-", 20, 43),
        "capitals and digits": lambda: run(upper + digits, 16, 32),
        "two parts": lambda: run(mixed, 8, 12) + pick("_", "-", ".") + run(mixed, 8, 12),
        "hexadecimal": lambda: "0x" + run("0123456789ABCDEF", 32, 64),
        "letters": lambda: run(lower + upper, 14, 40),
        "prefixed letters": lambda: pick("ghp_", "sk-", "glpat-", "key-") + run(lower + upper, 16, 40),
        "phrase": phrase,
        "within a path": within,
        "channel": lambda: pick("xoxb", "xoxp", "xapp") + "-" + "-".join(run(digits, 9, 14) for _ in range(rng.integers(1, 3))) + "-" + run(mixed, 16, 32),
        "short": lambda: run(mixed, 8, 13),
        "with signs": lambda: run(mixed + "!#$%&*?^~@+_.", 9, 24),
        "login": lambda: run(mixed, 8, 24),
        "uuid": lambda: "-".join(run(digits + "abcdef", k) for k in (8, 4, 4, 4, 12)),
        "assigned": lambda: pick("password", "token", "secret", "api_key") + "=" + run(mixed, 12, 32),
    }

    def secret() -> tuple[str, str, str]:
        """What stands before it, the secret, its kind."""
        kind = str(rng.choice(list(secrets)))
        body = secrets[kind]()
        if kind == "uuid":
            return pick("client_secret=", "client_secret: ", 'secret: "', "api_key="), body, kind
        if kind == "login":
            return pick("postgresql", "mysql", "ftp", "https", "redis") + "://" + pick(word(), "admin", "app") + ":", body, kind
        if kind in ("short", "with signs"):
            return pick('"password": "', "pwd=", "passwd: ", 'secret = "', "PASS=", "db_password: ", "password = '"), body, kind
        if len(body) < LEAST:
            body += run(digits, 6)
        if body in phrases:
            return pick("pwd=", "pwd: ", "login with ", "credential = ", "passphrase: ", "pass="), body, kind
        lead = pick("pwd=", "auth: ", "Authorization: Bearer ", "credential = ", 'private_key: "', "access_key=", "-H 'X-Key: ", "client_id ", "login with ", "use ", "", "", "")
        return lead, body, kind

    look_alikes = {
        "named word": lambda: (pick("password: ", "token = ", "secret: ", "pwd: ", "auth: ", 'passwd="'), pick(long_word(), "********", "<" + word() + "-" + word() + ">", "${" + word().upper() + "_" + word().upper() + "}", babble(4), word() + "-" + babble(3), "required", "unknown")),
        "page": lambda: (pick("see ", "", "at "), pick("http://", "https://") + word() + "." + word() + pick(".com", ".org", "") + "/" + path(int(rng.integers(1, 5))) + pick("?p=", "?id=", "#", "/") + number(1, 9999)),
        "server": lambda: (pick("http://", "amqp://", "redis://", "at "), word() + "." + word() + pick(".local:", ".example.org:", ":") + number(80, 9999) + "/" + word()),
        "numbered word": lambda: (pick("", "from ", "mailto "), f"{word()}.{number(1, 99)}"),
        "address": lambda: (pick("host ", "at ", "ip "), ".".join(number(10, 256) for _ in range(4))),
        "digits": lambda: (pick("card ", "no. ", "id ", "", "call ", "account ", "iban "), run(digits, 12, 24)),
        "telephone": lambda: (pick("call ", "tel ", ""), "-".join([run(digits, 3), run(digits, 3), run(digits, 4)])),
        "time": lambda: (pick("on ", "at ", ""), f"20{run(digits, 2)}-0{number(1, 9)}-1{number(0, 9)}T1{number(0, 9)}.{run(digits, 2)}"),
        "path with a number": lambda: (pick("http://", "see ", "path "), "/".join([word(), word(), number(1, 999), word()]) + pick("", ".html", ".py", "/")),
        "package": lambda: (pick("version ", "", "install "), f"{word()}-{word()}-{number(0, 9)}.{number(0, 30)}.{number(0, 9)}"),
        "name with a number": lambda: (pick("", "the ", "by "), word() + word() + word() + number(1, 2030)),
        "label": lambda: (pick("fig_", "table ", "chapter_"), f"{word()}_{word()}_{number(1, 99)}"),
        "identifier": lambda: (pick("id=", "uuid ", ""), "-".join(run(digits + "abcdef", k) for k in (8, 4, 4, 4, 12))),
        "checksum": lambda: (pick("sha1:", "checksum ", "commit "), run("0123456789ABCDEF", 40)),
        "rule with a number": lambda: (pick("", "see "), pick("--", "==", "..") * int(rng.integers(4, 20)) + number(1, 9)),
        "class with a number": lambda: (pick("name ", "", "class "), "".join(word().capitalize() for _ in range(3)) + number(1, 99)),
        "long word": lambda: (pick("", "the ", "of ", "use ", "with "), cased(long_word())),
        "hyphenated words": lambda: (pick("", "a ", "from "), cased(str(rng.choice(COMMON))) + "-" + long_word() + pick("", ".", "...")),
        "rule": lambda: (pick("", " ", "\n"), pick("-", "=", ".", "_", "+", "/") * int(rng.integers(12, 90))),
        "long path": lambda: (pick("", "path ", "see ", "in ", "http:", "https:"), pick("/", "//") + path(int(rng.integers(2, 16))) + pick("", "/", ".txt", ".")),
        "class": lambda: (pick("class ", "call ", "name ", "import "), pick("", "_", ".").join(title() for _ in range(int(rng.integers(2, 5))))),
        "settings name": lambda: (pick("", "import ", "set "), pick("_", ".", "-").join(segment() for _ in range(int(rng.integers(2, 6))))),
        "invented word": lambda: (pick("", "", "and ", "!! "), cased(babble(int(rng.integers(4, 9)))) + pick("", "", ".", "!!", "-", ",")),
        "shouted word": lambda: (pick("", "!! ", "THE "), (babble(int(rng.integers(4, 8))) if rng.random() < 0.6 else "".join(rng.choice(list("THEANDSTINGOURWLCMPBYF"), rng.integers(12, 18)))).upper() + pick("!!", "!!", ".", "")),
    }
    weights = {"checksum": 4, "long word": 2, "class with a number": 3, "hyphenated words": 2, "invented word": 5, "shouted word": 4, "named word": 3, "identifier": 4, "digits": 5, "page": 3}  # the nearest to secrets
    often = [k for k in look_alikes for _ in range(weights.get(k, 1))]

    def harmless() -> tuple[str, str, str]:
        kind = str(rng.choice(often))
        lead, body = look_alikes[kind]()
        return lead, body if len(body) >= LEAST else body + "." + word() + word() + word(), kind

    out = []
    for i in range(n):
        lead, body, kind = secret() if i % 2 else harmless()
        before, after = prose(int(rng.integers(0, 8))), prose(int(rng.integers(0, 8)))
        quote = "" if kind == "login" or lead[-1:] in ("'", '"') else pick('"', "'", "", "", "")
        head = before + pick(" ", "\n", " ", "") * bool(before) + lead + quote
        quote = lead[-1] if lead[-1:] in ("'", '"') else quote
        tail = (f"@{word()}.{word()}:{number(1000, 9999)}/{word()} " if kind == "login" else quote + pick(" ", ",", "\n", ". ", "@" if not i % 2 and rng.random() < 0.3 else " ")) + after
        text, start, end = head + body + tail, len(head), len(head) + len(body)
        run_of = next((span for span in candidates(text) if span[0] <= len(head) < span[1]), (start, end))
        out.append((text, *run_of, i % 2, kind))  # the whole run, as scans see it
    return out


@functools.lru_cache(maxsize=2)
def trained(n: int = FINDINGS, recall: float = RECALL, seed: int = SEED) -> Scanner:
    """The network after training on five sixths of ``n`` findings, calibrated and given its threshold on the rest."""
    rows = findings(n, seed)
    windows, y = [parts(*window(*r[:3])) for r in rows], np.array([r[3] for r in rows], float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    kept, used = order[: n // 6], order[n // 6 :]
    net = Net(seed, kernel=KERNEL, stride=STRIDE, filters=32, hidden=32)
    for epoch in range(EPOCHS):
        rng.shuffle(used)
        for k in range(0, len(used), 64):
            own = used[k : k + 64]
            flat = [p for i in own for p in windows[i]]
            owner = np.repeat(np.arange(len(own)), [len(windows[i]) for i in own])
            x, masks = arrays(flat)
            pools = net.pool(x, masks)
            features = np.hstack([p for p, _ in pools]).astype(np.float32)
            by_logit = np.lexsort((net.head(features)[1], owner))
            most = by_logit[np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)]  # of each finding the part with the largest logit
            x, features, pools = x[most], features[most], [(p[most], at[most]) for p, at in pools]
            h, z = net.head(features)
            g = net.zero()
            d = net.head_gradient(features, h, ((sigmoid(z) - y[own]) / len(own)).astype(np.float32), g)
            for j, (p, at) in enumerate(pools):
                net.pool_gradient(x, p, at, d[:, j * net.filters : (j + 1) * net.filters], g)
            net.step(g, 4e-3 * (1 - epoch / EPOCHS))
    scanner = Scanner(net, (1.0, 0.0), 0.5)
    by_pattern = np.array([covered(*rows[i][1:3], base_spans(rows[i][0])) for i in kept])
    seen = np.array([rows[i][1:3] in candidates(rows[i][0]) for i in kept])
    z, t = scanner.logits([window(*rows[i][:3]) for i in kept]).astype(float), y[kept]
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration: one scale and shift by gradient descent
        e = sigmoid(a * z + b) - t
        a, b = a - 0.05 * (e * z).mean(), b - 0.05 * e.mean()
    scanner.scale = (float(a), float(b))
    positive = np.sort((sigmoid(a * z + b) * seen)[(t == 1) & ~by_pattern])  # those found without the network set no threshold
    scanner.threshold = min(float(positive[int((1 - recall) * len(positive))]), *apart(scanner, seed).values())
    return scanner


def apart(scanner: Scanner, seed: int = SEED, n: int = APART, recall: float = KIND_RECALL) -> dict[str, float]:
    """For each kind of secret written apart from training, the highest threshold at which that share of them is found."""
    by_kind: dict[str, list[float]] = {}
    for text, start, end, label, kind in secret_findings.drawn(n, seed + 1):
        if label:
            spans = [c for c in candidates(text) if c[0] < end and c[1] > start]
            if covered(start, end, base_spans(text)):
                p = 1.0
            else:
                p = float(scanner.probabilities([window(text, *c) for c in spans]).max()) if spans else 0.0  # no candidate: missed
            by_kind.setdefault(kind, []).append(p)
    return {k: float(np.sort(v)[int((1 - recall) * len(v))]) for k, v in by_kind.items()}


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): per text an array of (kind, start, end) in code points, end exclusive, by start and then kind."""
    spark, kind = docs.sparkSession, require(docs, id_col).schema[0].dataType
    shared = spark.sparkContext.broadcast(scanner or trained())  # a few thousand weights
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            texts, out = batch.column(1), []
            for at in range(0, len(texts), 128):
                for spans in scanner.scan([t.as_py() or "" for t in texts[at : at + 128]]):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=[id_col, "found"])

    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, found array<struct<kind: string, start: long, end: long>>")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS]
    base = F.filter("found", lambda x: x["kind"] != "model")
    return found.select(id_col, *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
