"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit decreasing sees a document only as its length, and a sequence only as its remaining room,
so documents of one length are placed as runs: the planner walks the lengths from long to short,
asks a segment tree over remaining capacities for the tightest open room (O(log capacity)), and puts
as many documents of the run there as there are sequences with that room. Its input is a histogram
of at most ``capacity`` rows and its output a list of placed runs, both bounded by the capacity and
not by the corpus. The documents' ranks within their length are counted in the tokenising tasks and
summed by length over tasks, so no task ever holds all documents of one length.

Null and empty texts are documents of one token (the separator). Equal rows are packed one by one.
A null id is carried. A text of any length is tokenised whole and cut only beyond the capacity.
An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, require, slices
from .token_counts import byte_symbols

CAPACITY = 2048
SEPARATOR = 0
#: Fixed value: the split pattern of the word tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Fixed value: all but the characters on which the tokenizer's normaliser only lower-cases, and whose white space str.split() knows.
UNUSUAL = r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]"
#: Runs in each of the memo's two generations.
GENERATION = 150_000


class WordIds:
    """Ids of a text as unsigned 32-bit bytes, equal to the library's. No id spans white space, so runs of usual characters between it are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.unusual = re.compile(UNUSUAL)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.words, self.model = regex.compile(WORDS), self.library.model
        self.shifted = {b: c for b, c in byte_symbols().items() if ord(c) != b}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_run(self, run: str) -> bytes:
        """The same for a run of usual characters: lower-cased, cut into words, each word's bytes given to the merge model."""
        ids, run = array("I"), run.lower()
        if run.isalpha():
            words = [run]
        elif run[:-1].isalpha():  # what follows letters and is none is a word of its own
            words = [run[:-1], run[-1]]
        else:
            words = self.words.findall(run)
        for w in words:
            symbols = w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.shifted)
            ids.extend([t.id for t in self.model.tokenize(symbols)])
        return ids.tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Runs are numbered over all of ``texts`` at once, so that each different one is looked up once."""
        out, usual = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if t and (self.unusual.search(t) or "<|" in t and self.special.search(t)):
                out[i] = self.encode([t])[0]
            elif t:
                usual.append(i)
        if usual:
            runs = pc.utf8_split_whitespace(pa.array([texts[i] for i in usual], pa.large_string()))
            numbered = runs.values.dictionary_encode()
            found = self.remembered(numbered.dictionary.to_pylist())
            length = np.array([len(b) // 4 for b in found])
            flat, start = np.frombuffer(b"".join(found), "<u4"), np.concatenate(([0], np.cumsum(length)[:-1]))
            which = numbered.indices.to_numpy()
            lengths = length[which]
            ends = np.cumsum(lengths)
            ids = flat[np.repeat(start[which] - ends + lengths, lengths) + np.arange(ends[-1])].astype("<u4").tobytes()
            cuts = np.concatenate(([0], ends))[runs.offsets.to_numpy()] * 4
            for i, a, b in zip(usual, cuts.tolist(), cuts[1:].tolist()):
                out[i] = ids[a:b]
        return out

    def remembered(self, runs: list[str]) -> list[bytes]:
        """From the memo's two generations. When the young one is full it becomes the old one, so what keeps coming up stays."""
        young, old, out = self.young, self.old, []
        for r in runs:
            ids = young.get(r)
            if ids is None:
                ids = old.get(r)
                young[r] = ids = self.encode_run(r) if ids is None else ids
            out.append(ids)
        if len(young) > GENERATION:
            self.old, self.young = young, {}
        return out


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that its memo outlives a task. The library's own threads would only crowd the task slots."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, their CRC-32, ids (bytes of unsigned 32 bits, null unless ``keep_ids``), and the task and the rank in it among pieces of that length."""
    kind = require(docs, id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = word_ids(vocabulary), [0] * (capacity + 1), TaskContext.get().partitionId()
        end = np.array([SEPARATOR], "<u4").tobytes()
        schema = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("rank", pa.int64())])
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = []
                for i, ids in enumerate(words.ids(part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        n = min(capacity, total - start)
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((i, piece, start, n, zlib.crc32(own), own if keep_ids else None, task, seen[n]))
                        seen[n] += 1
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(columns[0]), *columns[1:]], names=[id_col, *schema.names[1:]])

    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary, task long, rank long")


class Tree:
    """Segment tree over remaining capacities; finds the smallest occupied one at or above a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        i = length + self.leaves
        if self.count[i]:
            return length
        while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): best fit decreasing of ``histogram[length]`` documents each."""
    tree, open_, runs, sequences = Tree(capacity), defaultdict(deque), [], 0

    def put(length: int, rank: int, first: int, n: int, room: int, each: int) -> int:
        """``each`` documents into each of ``n`` sequences from ``first``, all with that room; the next rank."""
        for k in range(each):
            runs.append((length, rank + k * n, n, first, capacity - room + k * length))
        open_[room - each * length].append((first, n))
        tree.add(room - each * length, n)
        return rank + each * n

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            room = tree.tightest(length)
            if room is None:
                room, fresh = capacity, -(-(end - rank) // (capacity // length))
                open_[room].append((sequences, fresh))
                tree.add(room, fresh)
                sequences += fresh
            first, n = open_[room].popleft()
            tree.add(room, -n)
            each = room // length  # a sequence that got one of them is the tightest for the next
            full = min(n, (end - rank) // each)
            if full:
                rank = put(length, rank, first, full, room, each)
            if full < n and rank < end:
                rank = put(length, rank, first + full, 1, room, end - rank)
                full += 1
            if full < n:
                open_[room].appendleft((first + full, n - full))
                tree.add(room, n - full)
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns besides length, task, rank; read twice, so pass a stored table) with sequence_id and offset."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("here"))
    before = per_task.withColumn("before", F.sum("here").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    first = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((runs, first))  # its size is bounded by the capacity, see plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, first = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "global_rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = first[n], first[n + 1]
                at[own] = lo + np.searchsorted(runs[lo:hi, 1], rank[own], side="right") - 1
            found = runs[at]
            kept = [c for c in batch.schema.names if c != "global_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                names=[*kept, "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "task"])
    carried = [c for c in pieces.columns if c not in ("task", "rank")]
    ranked = ranked.select(*carried, (F.col("rank") + F.col("before")).alias("global_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "global_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Every piece with its place: id, piece, start, length, sequence_id, offset, ids_crc32, and the ids themselves unless ``keep_ids`` is off."""
    pieces = tokenise(docs, vocabulary, capacity, id_col, text_col, keep_ids)
    return place(materialise(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)
