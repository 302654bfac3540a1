"""Near-duplicates by shingle similarity: SimHash candidates in min-wise cells, verified exactly.

At a similarity (Jaccard, of sets of five-word shingles) of 0.8, SimHash fingerprints of the sets differ in 10 of 64 bits
on average; blocks of bits at such a radius hold whole corpora. So fingerprints are dealt to cells by ``KEYS`` min-wise
shingle hashes instead (two texts at 0.8 miss all eight with probability 0.2^8). Each cell is searched
by the Gray-order index of :mod:`.simhash` within ``RADIUS`` bits first, and what it finds is verified on the
shingle sets themselves; then every pair of the cell that is still apart is verified too, unless the sizes of
the sets rule it out. So the radius only sets the order. Equal sets are one vertex. Only texts that share a cell with a
different one send their shingles; pairs already joined are not verified again, cells give back a
forest, cells with the same members (by number and 128 bits of hashes) are searched once, and cells of more than ``CELL``
vertices are cut into chunks whose pairs are searched apart.

Null and empty texts have no shingles and are alike; texts of fewer words than a shingle have one, of all their
words. A null id is the first of its group. Of rows equal in id and text one stays. Columns of any name are kept.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, require, unused
from .simhash import GrayIndex, components, find, gray_rank, majority, root, shingle_hashes

SHINGLE, SIMILARITY, KEYS, RADIUS, CELL = 5, 0.8, 8, 20, 1024
#: Fixed odd multipliers, one for each min-wise order.
MIX = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(KEYS)], np.uint64)


def row_key(docs: DataFrame, text_col: str):
    return F.xxhash64(docs[text_col])


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, row, vertex (digest of the shingle set), bits, keys."""
    kind = require(docs, id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex, bits, keys = [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), shingle)
                own = np.unique(h)
                vertex.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                bits.append(majority(own))
                mixed = (own[None, :] * MIX[:, None]) if len(own) else np.zeros((KEYS, 1), np.uint64)
                keys.append((mixed ^ (mixed >> np.uint64(29))).min(axis=1).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vertex, pa.string()), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "row", "vertex", "bits", "keys"])

    rows = docs.select(docs[id_col].alias("id"), row_key(docs, text_col).alias("row"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row long, vertex string, bits long, keys array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(vertex, shingles) of rows of (vertex, text): sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)], pa.binary())], names=["vertex", "shingles"])

    return texts.mapInArrow(run, "vertex string, shingles binary")


def verified_forest(bits: np.ndarray, sets: list[np.ndarray], threshold: float, radius: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of a spanning forest of all links of at least ``threshold``; those within ``radius`` bits are tried first."""
    index = GrayIndex(bits)
    at = np.argsort(gray_rank(bits), kind="stable")  # the member at each place of the index
    sizes = np.array([len(s) for s in sets])
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(words.max() + 1 if len(words) else 1, np.int32)
    parent, out = np.arange(len(bits)), []

    def verify(i: int, others: np.ndarray) -> None:
        others = others[root(parent, others) != find(parent, i)]
        others = others[(sizes[others] >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes[others])]
        if not len(others) or not sizes[i]:
            return
        own = words[starts[i] : starts[i + 1]]
        mark[own] = 1
        ends = np.cumsum(sizes[others])
        theirs = np.arange(ends[-1]) + np.repeat(starts[others] - ends + sizes[others], sizes[others])
        both = np.add.reduceat(mark[words[theirs]], ends - sizes[others])
        mark[own] = 0
        for j in others[both >= threshold * (sizes[i] + sizes[others] - both)]:
            a, b = find(parent, i), find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))

    for qi, place in index.near(bits, radius):
        member = at[place]
        later = member > qi
        qi, member = qi[later], member[later]
        for lo, hi in zip(*runs(qi)):
            verify(int(qi[lo]), member[lo:hi])
    for i in range(len(bits) - 1):  # what lies beyond the radius
        verify(i, np.arange(i + 1, len(bits)))
    return out


def runs(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(sorted_values):
        return [], []
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(sorted_values)]


def links(vertices: DataFrame, docs: DataFrame, threshold: float, shingle: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """Forest edges (a, b) among ``vertices`` (vertex, bits, keys, place), whose texts are in ``docs``."""
    keyed = vertices.select("vertex", "bits", "place", F.posexplode("keys").alias("k", "key"))
    members = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("vertex")).alias("s1"), F.bit_xor(F.xxhash64("vertex", F.lit(1))).alias("s2"))
    cells = keyed.groupBy("k", "key").agg(*members).filter("n > 1")
    shared = bounded(cells.groupBy("n", "s1", "s2").agg(F.min(F.struct("k", "key")).alias("c")).select("c.k", "c.key", "n"), "cells")  # of cells with the same members one is searched
    company = materialise(keyed.join(shared, ["k", "key"]).withColumn("cell", F.xxhash64("k", "key")), "company")
    holders = bounded(company.select("vertex", "place.id", "place.row").distinct(), "holders").withColumnsRenamed({"id": "id2", "row": "row2"})
    texts = docs.select(docs[id_col].alias("id"), row_key(docs, text_col).alias("row"), docs[text_col].alias("text"))
    texts = texts.join(holders, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2"))).select("vertex", "text")
    sets = materialise(shingle_sets(texts, shingle), "sets").dropDuplicates(["vertex"])
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("vertex"), F.col("chunks")).cast("int")
    dealt = (
        company.withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("vertex", "bits", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(sets, "vertex")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j", "vertex")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def search() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            bits = np.array([h[2] for h in held], np.int64).view(np.uint64)
            pairs = verified_forest(bits, [np.frombuffer(h[3], np.uint64) for h in held], threshold, radius)
            return pa.RecordBatch.from_arrays([pa.array([held[p[e]][1] for p in pairs], pa.string()) for e in (0, 1)], names=["a", "b"]) if pairs else None

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cell", "i", "j", "vertex", "bits", "shingles")]
            for cell, i, j, vertex, bits, shingles in zip(*cols):
                if held and held[0][0] != (cell, i, j):
                    if found := search():
                        yield found
                    held = []
                held.append(((cell, i, j), vertex, bits, shingles))
        if found := search():
            yield found

    return dealt.mapInArrow(run, "a string, b string").distinct()


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the least id of each group of near-duplicates, and all rows that are in none."""
    signed = materialise(signatures(docs, shingle, id_col, text_col), "signatures")
    vertices = materialise(signed.groupBy("vertex").agg(F.min(F.struct("id", "row")).alias("place"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "vertices")
    found = components(links(vertices, docs, threshold, shingle, radius, id_col, text_col))
    labelled = vertices.select("vertex", "place").join(found.withColumnRenamed("vertex", "v"), F.col("vertex") == F.col("v"), "left").withColumn("label", F.coalesce("label", "vertex"))
    id2, row2 = unused(docs, "id", "row")
    names = [F.col("id").alias(id2), F.col("row").alias(row2)]
    stays = materialise(labelled.groupBy("label").agg(F.min("place").alias("place")).select("place.id", "place.row").select(*names), "stays")
    here = docs[id_col].eqNullSafe(F.col(id2)) & (row_key(docs, text_col) == F.col(row2))
    repeated = bounded(signed.groupBy("id", "row").agg(F.count("*").alias("n")).filter("n > 1").select("id", "row"), "repeated")
    if repeated.isEmpty():
        return docs.join(stays, here, "left_semi")
    again = F.col(id2).eqNullSafe(F.col("id")) & (F.col(row2) == F.col("row"))
    several, single = stays.join(repeated, again, "left_semi"), stays.join(repeated, again, "left_anti")
    return docs.join(single, here, "left_semi").unionByName(docs.join(several, here, "left_semi").dropDuplicates([id_col, text_col]))
