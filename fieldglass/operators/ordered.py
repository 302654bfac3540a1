"""Ordered scans of groups of any size.

A window by a group's key alone puts a large group into one task. Here rows are first cut into slices: ranges of
(group, order), however few groups there are, so a slice never holds more than its share. A window then runs within
(slice, group), each slice gives a row of sums and edge values for each of its groups, and what came in earlier
slices is carried back by a join of those few rows. No row meets a row of another slice.

Slices are written to the shared folder, since ranges are drawn from a sample and must stay the same for both passes.
Nulls in a group's key are a group; nulls in the order go where ``order`` says. Rows that are equal in the whole order
stand in any order, as in a window. Empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldglass.shared import written

SLICE = "__slice"


def slices(df: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` with the number of its slice, written once."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(b).asc_nulls_first() for b in by], *order)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def within(by: Sequence[str], order: Sequence[Column] = ()) -> WindowSpec:
    """The window of a group's rows in one slice."""
    window = Window.partitionBy(SLICE, *by)
    return window.orderBy(*order) if order else window


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def carry(rows: DataFrame, by: Sequence[str], at: str, before: Mapping[str, Column] = {}, last: Mapping[str, str] = {}, following: Mapping[str, str] = {}, whole: Mapping[str, Column] = {}) -> DataFrame:
    """``rows`` of slices with what other slices of their group hold. ``at``: a row's place in its slice and group, from 1.

    ``before``: sums over all earlier slices; ``last``: a column's value at the last row before this slice, ``following``: at the first
    row after it; ``whole``: aggregates (sums, smallest or largest values) over all slices, one of F.sum, F.min, F.max.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    mine = ["__s", *keys]
    named = rows.select(F.col(SLICE).alias("__s"), *[F.col(b).alias(k) for b, k in zip(by, keys)], "*")
    edge = [F.sum(c).alias(n) for n, c in before.items()]
    edge += [F.max_by(F.struct(F.col(c).alias("v")), at).alias(n) for n, c in last.items()] + [F.min_by(F.struct(F.col(c).alias("v")), at).alias(n) for n, c in following.items()]
    parts = named.groupBy(*mine).agg(*edge, F.count(F.lit(1)).alias("__n"))
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__s", *before, *last, *following))).alias("__p"))  # one entry for each slice that holds the group

    def seen(x: Column, i: Column) -> Column:
        def total(n: str) -> Column:
            return F.aggregate(F.slice("__p", 1, i), F.lit(0).cast("double"), lambda acc, y: acc + F.coalesce(y[n], F.lit(0)))

        sums = [total(n).alias(n) for n in before]
        return F.struct(x["__s"].alias("s"), *sums, *[F.get("__p", i - 1)[n]["v"].alias(n) for n in last], *[F.get("__p", i + 1)[n]["v"].alias(n) for n in following])

    told = lists.select(*keys, F.explode(F.transform("__p", seen)).alias("__e")).select(*keys, F.col("__e.s").alias("__s"), *[F.col(f"__e.{n}").alias(n) for n in (*before, *last, *following)])
    to = [f"__t{i}" for i in range(len(mine))]
    out = named.join(told.withColumnsRenamed(dict(zip(mine, to))), same(mine, to)).drop(*to)
    if whole:
        ends = named.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()]).withColumnsRenamed(dict(zip(keys, to)))
        out = out.join(ends, same(keys, to)).drop(*to) if keys else out.crossJoin(F.broadcast(ends))  # one row
    return out.drop(*mine)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, size: str | None = None, parts: int | None = None) -> DataFrame:
    """``name``: 1, 2, ... within ``by`` in ``order``; ``size``: rows of the group."""
    cut = slices(df, by, order, parts).withColumn("__at", F.row_number().over(within(by, order)))
    rows = carry(cut, by, "__at", before={"__before": F.lit(1)}, whole={size: F.count(F.lit(1))} if size else {})
    return rows.withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__at", "__before", SLICE)


def neighboured(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, parts: int | None = None) -> DataFrame:
    """``__at`` (place in the slice), ``__place`` (in the group), ``__above`` and ``__below``: the value in the rows before and after. Still in slices."""
    window = within(by, order)
    cut = slices(df, by, order, parts).withColumns({"__at": F.row_number().over(window), "__above": F.lag(value).over(window), "__below": F.lead(value).over(window)})
    cut = cut.withColumn("__end", F.count(F.lit(1)).over(within(by)))
    rows = carry(cut, by, "__at", before={"__before": F.lit(1)}, last={"__prev": value}, following={"__next": value})
    above = F.when(F.col("__at") > 1, F.col("__above")).otherwise(F.col("__prev"))
    below = F.when(F.col("__at") < F.col("__end"), F.col("__below")).otherwise(F.col("__next"))
    place = (F.col("__at") + F.col("__before")).cast("long")
    return rows.withColumns({"__above": above, "__below": below, "__place": place}).drop("__before", "__prev", "__next", "__end")


def tiers(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column], threshold: float, parts: int | None = None) -> DataFrame:
    """``position_rank``, ``drop`` to the next value (0 for the last), ``tier`` (a new one after each gap of at least ``threshold``) and ``largest`` drop of the group."""
    rows = neighboured(df, by, order, value, parts)
    rows = rows.withColumns({"drop": F.coalesce(F.col(value) - F.col("__below"), F.lit(0.0)), "__new": F.coalesce((F.col("__above") - F.col(value) >= threshold).cast("int"), F.lit(0))})
    window = within(by, [F.col("__at")])
    rows = rows.withColumn("__sum", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    rows = carry(rows, by, "__at", before={"__earlier": F.col("__new")}, whole={"largest": F.max("drop")})
    tier = (1 + F.col("__sum") + F.col("__earlier")).cast("long")
    return rows.withColumns({"tier": tier, "position_rank": F.col("__place")}).drop("__at", "__place", "__above", "__below", "__new", "__sum", "__earlier", SLICE)


def steepness(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """``position_rank``, and slope plus absolute second difference of the ordered values, scaled to 0..1 within the group."""
    rows = neighboured(df, by, order, value, parts)
    before, here, after = F.col("__above"), F.col(value), F.col("__below")
    slope = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), here - after).when(after.isNull(), before - here).otherwise((before - after) / 2)
    rows = rows.withColumn("__raw", slope + F.coalesce(F.abs(before - 2 * here + after), F.lit(0.0)))
    rows = carry(rows, by, "__at", whole={"__low": F.min("__raw"), "__high": F.max("__raw")})
    flat = F.col("__high") == F.col("__low")
    scaled = (F.col("__raw") - F.col("__low")) / F.when(flat, F.lit(1.0)).otherwise(F.col("__high") - F.col("__low"))
    return rows.withColumns({name: F.coalesce(scaled, F.lit(0.0)), "position_rank": F.col("__place")}).drop("__at", "__place", "__above", "__below", "__raw", "__low", "__high", SLICE)


def sums_below(counts: DataFrame, by: Sequence[str], value: str, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows of distinct (by, value) with, for each column, the sum over smaller values (``<c>_below``) and over the group (``<c>_all``)."""
    order = [F.col(value).asc()]
    window = within(by, order)
    cut = slices(counts, by, order, parts)
    local = {f"__l_{c}": F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in columns}
    cut = cut.withColumns({"__at": F.row_number().over(window), **local})
    rows = carry(cut, by, "__at", before={f"__b_{c}": F.col(c) for c in columns}, whole={f"{c}_all": F.sum(c) for c in columns})
    return rows.withColumns({f"{c}_below": F.col(f"__l_{c}") + F.col(f"__b_{c}") for c in columns}).drop("__at", SLICE, *local, *[f"__b_{c}" for c in columns])


def joined_back(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``found``, one row for each of ``keys``; nulls meet nulls."""
    to = [f"__j{i}" for i in range(len(keys))]
    return df.join(found.withColumnsRenamed(dict(zip(keys, to))), same(keys, to), "left").drop(*to)


def percentiles(df: DataFrame, value: str, by: Sequence[str], up: str | None = None, down: str | None = None, scale: float = 10.0, parts: int | None = None) -> DataFrame:
    """Average-tie rank over the count of values, times ``scale``: of small to large values (``up``), of large to small (``down``). Null for nulls, which count for nobody.

    Ranks are taken over counts of distinct values, so a value that many rows share is one row of the scan.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = sums_below(counts, by, value, ["__n"], parts)
    half, below, n, every = (F.col("__n") + 1) / 2, F.col("__n_below"), F.col("__n"), F.col("__n_all")
    out = {k: c / every * scale for k, c in ((up, below + half), (down, every - below - n + half)) if k}
    return joined_back(df, ranked.withColumns(out).select(*by, value, *out), [*by, value])


def expanding_percentiles(df: DataFrame, value: str, by: Sequence[str], season: str, name: str, scale: float = 10.0, parts: int | None = None) -> DataFrame:
    """Share of smaller values in this and all earlier seasons, times ``scale``: no row is copied into a later season.

    Each distinct value of a group carries its counts up to each season; one scan in order of value adds them up, and a row reads
    the sums of its own season. Rows of unknown season are compared among themselves.
    """
    seasons = sorted(r[0] for r in df.select(season).distinct().collect() if r[0] is not None)  # a few dozen
    upto = {f"__c{i}": F.count(F.when(F.col(season) <= F.lit(s), F.lit(1))) for i, s in enumerate(seasons)} | {f"__c{len(seasons)}": F.count(F.when(F.col(season).isNull(), F.lit(1)))}
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in upto.items()])
    ranked = sums_below(counts, by, value, list(upto), parts)
    shares = F.array(*[F.col(f"{c}_below") / F.nullif(F.col(f"{c}_all"), F.lit(0)) * scale for c in upto])
    place = F.coalesce(*[F.when(F.col(season).eqNullSafe(F.lit(s)), F.lit(i)) for i, s in enumerate(seasons)], F.lit(len(seasons)))
    out = joined_back(df, ranked.select(*by, value, shares.alias("__shares")), [*by, value])
    return out.withColumn(name, F.get("__shares", place)).drop("__shares")


def thirds(df: DataFrame, value: str, by: Sequence[str], name: str = "risk", parts: int | None = None) -> DataFrame:
    """low, medium, high by the sorted values at a third and at two thirds of the group."""
    rows = numbered(df, by, [F.col(value).asc_nulls_last()], "__rn", "__n", parts)
    cuts = rows.groupBy(*by).agg(*[F.max(F.when(F.col("__rn") - 1 == F.floor(F.col("__n") * k / 3), F.col(value))).alias(f"__cut{k}") for k in (1, 2)])
    out = joined_back(rows, cuts, by) if by else rows.crossJoin(F.broadcast(cuts))  # one row
    label = F.when(F.col(value) < F.col("__cut1"), "low").when(F.col(value) < F.col("__cut2"), "medium").otherwise("high")
    return out.withColumn(name, label).drop("__rn", "__n", "__cut1", "__cut2")
