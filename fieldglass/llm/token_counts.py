"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial byte symbols less the merges made; no token id is ever emitted.
Pretokens repeat, so each worker keeps a bounded memo of pretoken -> count, cleared when full
(a speed matter only: a count never depends on it).

Nulls and empty texts count 0 tokens. Repeated rows are counted each. A null id stays null.
Texts of any length are counted whole. Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import require

#: The white space of the tokenizer library's patterns, and its byte-level split pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
LETTER, NUMBER = r"\p{L}", r"\p{N}"


def split_pattern(letter: str = LETTER, number: str = NUMBER, other: str = rf"[^{SPACE}\p{{L}}\p{{N}}]") -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def one_class(library, about: str, candidates: list[str]) -> list[str]:
    """Those characters that the library keeps together with ``about`` on both sides."""
    kept = []
    for at in range(0, len(candidates), 4096):
        part = candidates[at : at + 4096]
        starts = {5 * i for i in range(len(part))}  # each stands as "\nXcX\n"
        pieces = library.pre_tokenizer.pre_tokenize_str("".join(f"\n{about}{c}{about}\n" for c in part))
        kept += [part[(a - 1) // 5] for _, (a, b) in pieces if b - a == 3 and a - 1 in starts]
    return kept


@functools.lru_cache(maxsize=4)
def differing(path: str) -> frozenset[str]:
    """Letters and numbers of the pattern module, whose Unicode tables are newer, that the library of this vocabulary takes for neither."""
    from tokenizers import Tokenizer

    library, letter, number = Tokenizer.from_file(path), regex.compile(LETTER), regex.compile(NUMBER)
    every = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    here = {c: "L" if letter.match(c) else "N" for c in every if letter.match(c) or number.match(c)}  # newer tables only add to these
    there = {c: "L" for c in one_class(library, "a", [c for c in here if here[c] == "L"])} | {c: "N" for c in one_class(library, "1", [c for c in here if here[c] == "N"])}
    return frozenset(here.keys() - there.keys())


def ranges(characters: Iterable[str]) -> str:
    """The characters as the inside of a pattern's class."""
    codes = sorted(map(ord, characters))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


MEMO_ENTRIES = 300_000
MEMO_CHARS = 64


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


def merge_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Merges made when the adjacent pair of lowest rank (leftmost among equals) is merged until none is left."""
    n = len(symbols)
    after, before, value = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if value[i] >= 0 else n
        if j >= n or (value[i], value[j]) != pair:
            continue  # one side has been merged since
        value[i], value[j] = ranks[pair][1], -1
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (right := (value[i], value[k])) in ranks:
                heapq.heappush(heap, (ranks[right][0], i, right))
        if (h := before[i]) >= 0 and (left := (value[h], value[i])) in ranks:
            heapq.heappush(heap, (ranks[left][0], h, left))
    return merges


class Counter:
    """Counts of one byte-level vocabulary file, as its library gives them without added special tokens."""

    def __init__(self, path: str, differences: Iterable[str] = ()):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.byte = [vocab[c] for _, c in sorted(byte_symbols().items())]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(split_pattern())
        self.odd = self.adjusted = None
        if differences:
            odd = ranges(differences)
            kind = {"L": rf"[\p{{L}}--[{odd}]]", "N": rf"[\p{{N}}--[{odd}]]", "O": rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{odd}]]"}
            self.odd, self.adjusted = regex.compile(f"[{odd}]"), regex.compile(split_pattern(kind["L"], kind["N"], kind["O"]), regex.V1)
        self.memo: dict[str, int] = {}

    def pretoken(self, s: str) -> int:
        symbols = [self.byte[b] for b in s.encode("utf-8")]
        return len(symbols) - merge_count(symbols, self.ranks)

    def plain(self, s: str) -> int:
        memo, total = self.memo, 0
        split = self.adjusted if self.odd and self.odd.search(s) else self.split
        pieces = split.findall(s) if len(s) < 1 << 20 else (m[0] for m in split.finditer(s))
        for p in pieces:
            n = memo.get(p)
            if n is None:
                n = self.pretoken(p)
                if len(p) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[p] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.lru_cache(maxsize=1)
def counter_of(path: str, differences: frozenset[str]) -> Counter:
    """One per worker process, so that its memo outlives a task."""
    return Counter(path, differences)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a byte-level BPE json file on every machine."""
    kind = require(docs, id_col).schema[0].dataType
    differences = differing(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary, differences)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts = [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
