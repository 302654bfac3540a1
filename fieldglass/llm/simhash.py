"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most r bits agree on at least two of r + 2 blocks of bits, so each
distinct fingerprint is dealt once per pair of blocks, to the cell of those blocks' values; no pair is missed.
At r = 3 that is ten cells of 25 or 26 bits each: 10^11 fingerprints give some 1,500 to a cell.
A cell is searched through a Gray-order index: fingerprints sorted by Gray rank (neighbours in that
order differ in few bits), cut into nodes of doubling size that hold the bits all members share and
their values. A query adds up its differences from a node's shared bits and drops the whole
node beyond r. Nodes whose members can't differ in more than r bits are linked as a whole. A cell
gives back a forest (each fingerprint linked to one of its component), never all pairs. Cells with
more than ``CELL`` fingerprints are cut into chunks: each chunk is searched in itself once, and each pair of chunks
against one another, so a hot block value is searched by many tasks. Forests are joined by iterated star contraction
on tables. Fingerprints that many rows share (empty texts, boilerplate) are joined back by broadcast, the others by a shuffle.

Nulls count as empty texts; empty texts have fingerprint zero and link like others. Equal texts have
equal fingerprints and are one vertex. A null id is never a representative unless all are null.
Rows that repeat an id are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bounded, discard, materialise, require

SEED = 42
RADIUS = 3
#: Fingerprints that one task searches at once; larger cells are cut into pairs of chunks.
CELL = 8192
#: Rows from which a fingerprint is not joined by a shuffle.
HOT = 10_000
WIDTH = 64
#: Edges of a task that go out together.
EDGES = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (fewer words: of all; none: no hash)."""
    words = (text or "").encode("utf-8").translate(LOWER_BYTES).split()  # bytes.split() parts at 0x20 and 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    sums = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): the fingerprint of every whole text as a signed 64-bit number."""
    kind = require(docs, id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            bits = np.array([majority(shingle_hashes(texts[i].as_py(), shingle)) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=[id_col, "bits"])

    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, bits long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place in Gray-code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(shift))
    return v


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; level k has nodes of LEAF * FAN**k members, each with its shared bits and their values."""

    LEAF, FAN = 16, 8

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        all_and = all_or = None
        step = self.LEAF
        while len(self.values):
            base, width = (self.values, step) if all_and is None else (None, self.FAN)
            a = np.bitwise_and.reduceat(base if base is not None else all_and, np.arange(0, len(base if base is not None else all_and), width))
            o = np.bitwise_or.reduceat(base if base is not None else all_or, np.arange(0, len(base if base is not None else all_or), width))
            all_and, all_or = a, o
            self.levels.append((~(a ^ o), a))  # bits on which all members agree, and their values
            if len(a) == 1:
                break

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, member) within ``radius``, as blocks: whole levels of (query, node) are tested at once and cut."""
        for at in range(0, len(queries), 512):
            q = np.arange(at, min(at + 512, len(queries)))
            top_mask, _ = self.levels[-1]
            qi, node = np.repeat(q, len(top_mask)), np.tile(np.arange(len(top_mask)), len(q))
            for k in range(len(self.levels) - 1, -1, -1):
                mask, shared = self.levels[k]
                keep = np.bitwise_count((queries[qi] ^ shared[node]) & mask[node]) <= radius
                qi, node = qi[keep], node[keep]
                fan, below = (self.FAN, len(self.levels[k - 1][0])) if k else (self.LEAF, len(self.values))
                qi = np.repeat(qi, fan)
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                inside = node < below
                qi, node = qi[inside], node[inside]
            keep = np.bitwise_count(queries[qi] ^ self.values[node]) <= radius
            yield qi[keep], node[keep]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(values: np.ndarray, radius: int, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least fingerprint of its component) of the links among ``values``, or only of those between ``values`` and ``others``. All are distinct."""
    index = GrayIndex(values)
    n = len(index.values)
    members = index.values if others is None else np.concatenate([index.values, others])
    parent = np.arange(len(members))
    if others is None:
        mask, _ = index.levels[0]
        for node in np.flatnonzero(WIDTH - np.bitwise_count(mask) <= radius):  # so alike that all members link
            lo, hi = node * index.LEAF, min((node + 1) * index.LEAF, n)
            parent[lo:hi] = lo
    shift = 0 if others is None else n
    for qi, member in index.near(members[shift:], radius):
        a, b = qi + shift, member
        while True:  # vectorised union: hang the larger root below the smaller until both ends agree
            ra, rb = root(parent, a), root(parent, b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    top = root(parent, np.arange(len(members)))
    least = np.full(len(members), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, top, members)
    linked = least[top] != members
    return members[linked], least[top][linked]


def root(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    up = parent[i]
    while True:
        nxt = parent[up]
        if (nxt == up).all():
            return up
        up = nxt


def cell_keys(bits: str, radius: int) -> Column:
    """For each pair of ``radius + 2`` blocks, one number of the pair and both values: two fingerprints within the radius have one in common."""
    edges = [WIDTH * i // (radius + 2) for i in range(radius + 3)]
    spans = list(zip(edges, edges[1:]))

    def part(lo: int, hi: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(bits, WIDTH - hi), WIDTH - hi + lo)

    pairs = [(a, b) for i, a in enumerate(spans) for b in spans[i + 1 :]]
    return F.array(*[F.struct(F.lit(k).alias("pair"), F.shiftleft(part(*a), b[1] - b[0]).bitwiseOR(part(*b)).alias("part")) for k, (a, b) in enumerate(pairs)])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges (a, b) over the distinct fingerprints in column ``bits``; a and b are in one component through links of at most ``radius`` bits."""
    dealt = distinct.select("bits", F.explode(cell_keys("bits", radius)).alias("k")).select("bits", "k.pair", "k.part")
    sizes = dealt.groupBy("pair", "part").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    cells = (
        dealt.join(sizes.withColumn("chunks", chunks), ["pair", "part"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bits", "pair", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        .repartition("pair", "part", "i", "j")
        .sortWithinPartitions("pair", "part", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell, or a pair of chunks of one, at a time: the rows come in their order."""
        cell, held, out, size = None, [], [], 0

        def search() -> None:
            nonlocal size
            bits, own = (np.concatenate(v) for v in zip(*held))
            if cell[2] == cell[3]:
                found = forest(bits, radius) if len(bits) > 1 else None
            else:  # two chunks of one cell: each is searched in itself elsewhere
                left = own == cell[2]
                found = forest(bits[left], radius, bits[~left]) if left.any() and not left.all() else None
            if found and len(found[0]):
                out.append(found)
                size += len(found[0])

        def flush() -> pa.RecordBatch:
            nonlocal size
            edges = [pa.array(np.concatenate(v).view(np.int64)) for v in zip(*out)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(edges, names=["a", "b"])

        for batch in (t for t in batches if t.num_rows):
            bits, own, *cols = (batch.column(c).to_numpy() for c in ("bits", "own", "pair", "part", "i", "j"))
            bits = bits.view(np.uint64)
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(bits)]):
                here = tuple(int(c[lo]) for c in cols)
                if held and here != cell:
                    search()
                    held = []
                cell = here
                held.append((bits[lo:hi], own[lo:hi]))
            if size >= EDGES:
                yield flush()
        if held:
            search()
        if out:
            yield flush()

    return cells.mapInArrow(run, "a long, b long").distinct()


def seal(edges: DataFrame) -> tuple:
    """Number of edges and two sums over them, so that two sets of edges can be compared without a join."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, label): the least vertex of each component, by alternating large and small stars until nothing changes.

    Each round works on at most as many edges as there were at first, aggregates before it joins, and is written to the shared folder.
    """
    at = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct(), "edges")
    now = seal(at)
    for _ in range(rounds):
        both = at.unionByName(at.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("v != u").distinct()
        new = materialise(small, "edges")
        before, now = now, seal(new)
        discard(at)
        if before == now:
            return new.select(F.col("v").alias("vertex"), F.col("u").alias("label"))
        at = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable over links."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialise(prints.groupBy("bits").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("bits"), radius))
    labelled = distinct.join(found, distinct.bits == found.vertex, "left").select("bits", "n", "least", F.coalesce("label", "bits").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_bits = materialise(labelled.join(smallest, "label").select("bits", "n", "component_id"), "labelled")
    hot = bounded(by_bits.filter(F.col("n") > HOT), "hot").drop("n")  # one row for HOT rows and more
    others = prints.join(hot.select("bits"), "bits", "left_anti").join(by_bits.filter(F.col("n") <= HOT).drop("n"), "bits")
    out = prints.join(hot, "bits").unionByName(others)
    return out.select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
