"""Joins of points with the ranges that hold them, by equal keys only.

A range of whole numbers is cut into dyadic pieces, at most two of each size; a point lies in one piece of each size.
Both sides are keyed by (group, size, piece), so a point meets just the ranges that hold it: no pair is made and then
filtered away, however many ranges a group has. Points that are equal meet the ranges once. A hot group is spread over
its pieces.

Where only totals over a point's ranges are asked for, ``range_totals`` adds up the ranges of each piece and the pieces of
each distinct point: no pair of a point and a range is made at all, so the work grows with rows and not with pairs.

Ends belong to the range. A range with a null end or group, or whose end lies before its start, holds nothing; a null
point lies in none. Ends and points must be within +-2^60.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.shared import written

#: Sizes of pieces: 2^0 to 2^61.
SIZES = 62


def pieces(low: Column, high: Column) -> Column:
    """Array of (size, piece) that make up the range from ``low`` to ``high``, both within."""

    def of_size(k: Column) -> Column:
        first, end = _up(low, k), _down(high + 1, k)
        left = F.when((first < end) & (F.pmod(first, F.lit(2)) == 1), F.struct(k.alias("size"), first.alias("piece")))
        right = F.when((first < end) & (F.pmod(end, F.lit(2)) == 1), F.struct(k.alias("size"), (end - 1).alias("piece")))
        return F.array(left, right)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), of_size))
    return F.filter(every, lambda x: x.isNotNull())


def _down(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), k)


def _up(x: Column, k: Column) -> Column:
    return -_down(-x.cast("long"), k)


def range_join(points: DataFrame, ranges: DataFrame, by: Sequence[str], point: str, low: str, high: str, how: str = "left") -> DataFrame:
    """``points`` with the columns of each range of their group that holds them. ``how``: left or inner. Names of ``ranges`` other than ``by`` must not be in ``points``."""
    keys = [f"__b{i}" for i in range(len(by))]
    cut = _cut(ranges, by, keys, low, high)
    found = _spread(points, cut, by, keys, point).join(cut, [*keys, "__size", "__piece"]).drop("__size", "__piece")
    return points.join(found, _same(by, keys, point), how).drop(*keys, "__x")


def range_totals(points: DataFrame, ranges: DataFrame, by: Sequence[str], point: str, low: str, high: str, sums: Mapping[str, Column]) -> DataFrame:
    """``points``, each row once, with sums over the ranges of their group that hold them: name -> column over ``ranges``. Null where no range holds the point, or none with a value."""
    keys = [f"__b{i}" for i in range(len(by))]
    named = ranges.select(*by, low, high, *[c.alias(n) for n, c in sums.items()])
    total = [F.sum(n).alias(n) for n in sums]
    same = named.groupBy(*by, low, high).agg(*total)  # equal ranges are cut once
    cut = written(_cut(same, by, keys, low, high).groupBy(*keys, "__size", "__piece").agg(*total), "pieces")
    found = _spread(points, cut, by, keys, point).join(cut, [*keys, "__size", "__piece"]).groupBy(*keys, "__x").agg(*total)
    return points.join(found, _same(by, keys, point), "left").drop(*keys, "__x")


def _cut(ranges: DataFrame, by: Sequence[str], keys: Sequence[str], low: str, high: str) -> DataFrame:
    """A row for each piece of each range."""
    cut = ranges.withColumn("__p", F.explode(pieces(F.col(low), F.col(high)))).withColumns({"__size": F.col("__p.size"), "__piece": F.col("__p.piece")}).drop("__p")
    return cut.withColumnsRenamed(dict(zip(by, keys)))


def _spread(points: DataFrame, cut: DataFrame, by: Sequence[str], keys: Sequence[str], point: str) -> DataFrame:
    """A row for each distinct point and each size of piece there is."""
    sizes = sorted(r[0] for r in cut.select("__size").distinct().collect())  # 62 at most
    ones = points.filter(F.col(point).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(point).cast("long").alias("__x")).distinct()
    return ones.withColumn("__size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("__piece", _down(F.col("__x"), F.col("__size")))


def _same(by: Sequence[str], keys: Sequence[str], point: str) -> Column:
    same = F.col(point) == F.col("__x")
    for b, k in zip(by, keys):
        same = same & (F.col(b) == F.col(k))
    return same
