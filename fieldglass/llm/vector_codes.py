"""Vector codes: each of four equal parts of a vector becomes the index of its nearest codebook entry.

Components are integers, floor(1024 x), so distances, sums and means are exact. Entries are searched through a ball
tree per part position: a search starts with the leaf of the nearest balls and visits every ball that may hold an entry
as near as the best so far. Radii and distances of balls are doubles, rounded outwards; a ball at just the best distance
is visited; entries themselves are compared by integer squared distance, and of equal ones the lowest index wins.

A round of fitting is one pass over the rows: each task sums up its parts by (position, entry), a shuffle adds those
few rows, and the driver holds the codebooks alone (at most ``ENTRIES`` x dimension integers).

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Of rows that repeat an
id, each counts; equal ids stand in the order of their vectors in the first codebook. Fewer than ``ENTRIES`` rows make
a smaller codebook. Vectors of another length than that of the smallest id, and vectors with components beyond
``LARGEST`` (whose squares would not fit a long), stay in the result with null code and errors and train nothing. A
length not divisible by four gives the first parts one component more; empty vectors have codes of zeros. Null labels
are one group. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, require

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components up to this keep a part's squared distance within a long.
LARGEST = 1 << 26
LEAF = 8
#: Components handled at once.
CHUNK = 1 << 20


class BallTree:
    """Nearest entry of a codebook by exact integer distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.balls: list[tuple[np.ndarray, float, int, int, np.ndarray | None]] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        points = self.entries[members].astype(np.float64)
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        at = len(self.balls)
        if len(members) <= LEAF:
            self.balls.append((centre, radius, -1, -1, np.sort(members)))
            return at
        self.balls.append((centre, radius, -1, -1, None))
        widest = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if points.shape[1] else 0
        order = np.argsort(points[:, widest], kind="stable") if points.shape[1] else np.arange(len(members))
        half = len(members) // 2
        left, right = self._grow(members[order[:half]]), self._grow(members[order[half:]])
        self.balls[at] = (centre, radius, left, right, None)
        return at

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        wide = parts.astype(np.float64)
        best, index = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(self.entries), np.int64)

        def away(ball: int, rows: np.ndarray) -> np.ndarray:
            d = wide[rows] - self.balls[ball][0]
            return np.sqrt(np.einsum("ij,ij->i", d, d))

        def compare(ball: int, rows: np.ndarray) -> None:
            for entry in self.balls[ball][4].tolist():
                d = parts[rows] - self.entries[entry]
                d = np.einsum("ij,ij->i", d, d)
                nearer = (d < best[rows]) | (d == best[rows]) & (entry < index[rows])
                best[rows[nearer]], index[rows[nearer]] = d[nearer], entry

        def start(ball: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            _, _, left, right, members = self.balls[ball]
            if members is not None:
                compare(ball, rows)
                return
            to_left = away(left, rows) <= away(right, rows)
            start(left, rows[to_left])
            start(right, rows[~to_left])

        def visit(ball: int, rows: np.ndarray) -> None:
            centre, radius, left, right, members = self.balls[ball]
            d = away(ball, rows)
            least = d * (1 - 1e-9) - radius
            rows = rows[least <= np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-9) + 1e-6]
            if not len(rows):
                return
            if members is not None:
                compare(ball, rows)
                return
            visit(left, rows)
            visit(right, rows)

        everyone = np.arange(len(parts))
        start(0, everyone)
        visit(0, everyone)
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Integer entries of each part position, ``width`` components in all."""

    width: int
    entries: tuple[np.ndarray, ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.entries for entry in book.tolist() for v in entry).encode()).hexdigest()


def cuts(width: int) -> list[int]:
    """Where parts begin and end."""
    short, more = divmod(width, PARTS)
    return [k * short + min(k, more) for k in range(PARTS + 1)]


def kept(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def fits(vector: str, width: int) -> Column:
    return (F.size(vector) == width) & F.forall(vector, lambda x: F.abs(x) < LARGEST / SCALE)


def integers(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), width)


def chunks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CHUNK // max(1, width))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def first_entries(rows: DataFrame, id_col: str, vector_col: str) -> Codebooks | None:
    """The vectors of the smallest ids, cut in parts; their number is bounded."""
    first = rows.orderBy(id_col, vector_col).select(F.size(vector_col)).first()
    if first is None:
        return None
    few = rows.filter(fits(vector_col, first[0])).orderBy(id_col, vector_col).limit(ENTRIES).select(vector_col).collect()
    x = np.floor(np.array([r[0] for r in few], np.float64).reshape(len(few), first[0]) * SCALE).astype(np.int64)
    at = cuts(first[0])
    return Codebooks(first[0], tuple(x[:, a:b] for a, b in zip(at, at[1:])))


def refined(rows: DataFrame, vector_col: str, books: Codebooks) -> Codebooks:
    """One round: assign all parts, and move each entry that is used to the floor of its parts' mean."""
    at, widest = cuts(books.width), max(b.shape[1] for b in books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books.entries if len(b)]
        total = [np.zeros((len(b), widest), np.int64) for b in books.entries]
        count = [np.zeros(len(b), np.int64) for b in books.entries]
        for batch in (c for whole in batches for c in chunks(whole, books.width)):
            x = integers(batch.column(0), books.width)
            for k, tree in enumerate(trees):
                part = x[:, at[k] : at[k + 1]]
                index, _ = tree.nearest(part)
                np.add.at(total[k], (index[:, None], np.arange(part.shape[1])[None]), part)
                count[k] += np.bincount(index, minlength=len(count[k]))
        for k in range(PARTS):
            used = np.flatnonzero(count[k])
            if len(used):
                lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * widest, pa.array(total[k][used].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[k][used]), lists], names=["part", "entry", "n", "total"])

    each = rows.filter(fits(vector_col, books.width)).select(vector_col).mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(widest)])
    after = [b.copy() for b in books.entries]
    for r in added.collect():  # one row for each entry of a position
        width = after[r.part].shape[1]
        after[r.part][r.entry] = [t // r.n for t in r[3 : 3 + width]]
    return Codebooks(books.width, tuple(after))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table; none where no vector is left."""
    rows = require(vectors, id_col, vector_col).filter(kept(vector_col))
    books = first_entries(rows, id_col, vector_col)
    for _ in range(rounds if books else 0):
        books = refined(rows, vector_col, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of all rows that are kept."""
    at = cuts(books.width)
    rows = require(vectors, id_col, label_col, vector_col).filter(kept(vector_col))
    kinds = dict(rows.dtypes)
    rows = rows.toDF("id", "label", "vector").withColumn("vector", F.when(fits("vector", books.width), F.col("vector")))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books.entries if len(b)]
        for batch in (c for whole in batches for c in chunks(whole, books.width)):
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = integers(batch.column(2).drop_null(), books.width)
            index, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for k, tree in enumerate(trees):
                found, d = tree.nearest(x[:, at[k] : at[k + 1]])
                index[:, k] = found
                error += d
            code, wide = np.full(len(there), None, object), np.zeros(len(there), np.int64)
            code[there], wide[there] = [r.tobytes().hex() for r in index], error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(wide, mask=~there)], names=["id", "label", "code", "error"])

    return rows.mapInArrow(codes, f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of all rows that are kept."""
    books = fit(vectors, id_col, vector_col)
    if books is None:
        kind = dict(vectors.dtypes)[id_col]
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = materialise(encode(vectors, books, id_col, vector_col, label_col), "codes")
    by_label = bounded(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(by_label, rows["label"].eqNullSafe(by_label["same"]))
    out = materialise(joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), "compressed")
    discard(rows)
    return out


def oracle() -> str:
    """The same in SQL, a round after a round."""
    d = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i])))"
    sql = """
WITH ints AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, k AS part, v[k * (len(v) // 4) + 1 : (k + 1) * (len(v) // 4)] AS v FROM ints, range(4) t(k)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256),"""
    for r in range(ROUNDS + 1):
        sql += f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(v) AS v, min((d, entry)) AS best FROM (
    SELECT p.vec_id, p.label, p.part, p.v, e.entry, CAST({d} AS BIGINT) AS d FROM parts p JOIN book{r} e ON p.part = e.part) GROUP BY ALL),"""
        if r < ROUNDS:
            sql += f"""
moved{r} AS (
  SELECT part, entry, list(c ORDER BY pos) AS v FROM (
    SELECT part, best[2] AS entry, pos, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c
    FROM (SELECT part, best, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM near{r}) GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN moved{r} m USING (part, entry)),"""
    return (
        sql
        + f"""
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""
    )
