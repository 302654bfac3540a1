"""Window expressions. Each has a total order where its result depends on one, and says where nulls go."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import column_safe

__all__ = [
    "best_other", "descending", "gap_to_next", "gradient", "keep_first", "latest", "minmax_all", "minmax_by", "minmax_within", "next_true_distance",
    "percentile_expanding", "percentile_rank", "percentile_reversed", "place", "running_tier", "softmax", "terciles", "top_k", "weighted_draw",
]


def group(by: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*by)


def descending(by: Sequence[str], *order: Column | str) -> WindowSpec:
    first, *rest = order
    return group(by).orderBy(column_safe(first).desc_nulls_last(), *[column_safe(c).asc_nulls_last() for c in rest])


def percentile_rank(value: Column | str, by: Sequence[str], higher_is_better: bool = True, scale: float = 10.0) -> Column:
    """Average-tie rank over the count of values, times ``scale``; nulls have no rank and count for nobody."""
    value = column_safe(value)
    window = group(by).orderBy(value.asc_nulls_last() if higher_is_better else value.desc_nulls_last())
    # one ordering serves all three: values before, values up to and with the ties, all values
    upto, whole = window.rangeBetween(Window.unboundedPreceding, Window.currentRow), window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = (F.rank().over(window) + F.count(value).over(upto)) / 2
    return F.when(value.isNotNull(), middle / F.count(value).over(whole) * scale)


def percentile_reversed(value: Column | str, by: Sequence[str], scale: float = 10.0) -> Column:
    """Share of values not beaten, for measures of which less is better: (1 - percentile) times ``scale``."""
    return scale - percentile_rank(value, by, True, scale)


def percentile_expanding(df: DataFrame, value: str, by: Sequence[str], season: str, name: str, scale: float = 10.0) -> DataFrame:
    """Share of smaller values in this and all earlier seasons, times ``scale``.

    Each row is spread over its season and the later ones (a few dozen at most) and ranked in each; no row meets another by a range join.
    """
    seasons = df.agg(F.collect_set(season).alias("__seasons"))  # one row
    spread = df.crossJoin(F.broadcast(seasons)).withColumn("__s", F.explode_outer(F.filter("__seasons", lambda s: s >= F.col(season))))
    window = group([*by, "__s"]).orderBy(F.col(value).asc_nulls_last())
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.when(F.col(value).isNotNull(), (F.rank().over(window) - 1) / F.count(value).over(whole) * scale)
    return spread.withColumn(name, share).filter(F.col("__s").eqNullSafe(F.col(season))).drop("__s", "__seasons")


def minmax_within(value: Column | str, by: Sequence[str], invert: bool = False, null_as: float = 0.0) -> Column:
    """Scaled to 0..1 within the group; a constant group gives 0 (inverted 1), null gives ``null_as``."""
    value = column_safe(value)
    low, high = F.min(value).over(group(by)), F.max(value).over(group(by))
    scaled = (value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.coalesce(1 - scaled if invert else scaled, F.lit(null_as))


def minmax_all(df: DataFrame, value: str, name: str) -> DataFrame:
    """Scaled to 0..1 over all rows, by a joined one-row aggregate, not by a window without partitions. Null stays null."""
    return minmax_by(df, [], {name: (value, False, None)})


def minmax_by(df: DataFrame, by: Sequence[str], scales: Mapping[str, tuple[str, bool, float | None]]) -> DataFrame:
    """Columns name -> (value, inverted, what null gives) scaled to 0..1 within ``by``: one aggregate of all ends, joined back.

    Unlike a window, a group's rows stay in the tasks they are in, so a few large groups do not become a few tasks.
    """
    keys, at = [f"__g{i}" for i in range(len(by))], range(len(scales))
    ends = [agg(v).alias(f"__{end}{i}") for i, (v, _, _) in zip(at, scales.values()) for end, agg in (("low", F.min), ("high", F.max))]
    found = df.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(*ends)
    if by:
        joined = df.join(found, functools.reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]), "left")
    else:
        joined = df.crossJoin(F.broadcast(found))  # one row
    out = {}
    for i, (name, (value, invert, null_as)) in zip(at, scales.items()):
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        scaled = (F.col(value) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
        scaled = 1 - scaled if invert else scaled
        out[name] = scaled if null_as is None else F.coalesce(scaled, F.lit(null_as))
    return joined.withColumns(out).drop(*keys, *[f"__{end}{i}" for i in at for end in ("low", "high")])


def keep_first(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("__rn", F.row_number().over(group(by).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest(df: DataFrame, by: Sequence[str], when: str, *ties: str) -> DataFrame:
    """The latest row of each key; unknown times are oldest, then ``ties`` decide."""
    return keep_first(df, by, F.col(when).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])


def place(by: Sequence[str], value: str, *ties: str) -> Column:
    """1, 2, ... from the largest value down."""
    return F.row_number().over(descending(by, value, *ties))


def top_k(df: DataFrame, k: int | Column, by: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(group(by).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def gap_to_next(by: Sequence[str], value: str, *ties: str) -> Column:
    """How far the next smaller value lies below; 0 for the last."""
    return F.coalesce(F.col(value) - F.lead(value).over(descending(by, value, *ties)), F.lit(0.0))


def running_tier(df: DataFrame, by: Sequence[str], value: str, name: str, threshold: float, *ties: str) -> DataFrame:
    """Adds tier numbers from 1: a new tier begins after each gap of at least ``threshold``."""
    window = descending(by, value, *ties)
    marked = df.withColumn("__new", F.coalesce((F.lag(value).over(window) - F.col(value) >= threshold).cast("int"), F.lit(0)))
    return marked.withColumn(name, 1 + F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def gradient(by: Sequence[str], value: str, *ties: str) -> Column:
    """Slope (central, one-sided at the ends) plus absolute second difference of the values from large to small."""
    window = descending(by, value, *ties)
    before, here, after = F.lag(value).over(window), F.col(value), F.lead(value).over(window)
    slope = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), here - after).when(after.isNull(), before - here).otherwise((before - after) / 2)
    return slope + F.coalesce(F.abs(before - 2 * here + after), F.lit(0.0))


def best_other(by: Sequence[str], value: str, *ties: str) -> Column:
    """Largest value among the other rows of the group; null if there is none."""
    window = descending(by, value, *ties)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.when(F.row_number().over(window) == 1, F.nth_value(value, 2).over(whole)).otherwise(F.first(value).over(whole))


def next_true_distance(flag: Column | str, at: str, by: Sequence[str]) -> Column:
    """Rows strictly between this one and the next with the flag; to the end if there is none. ``at`` counts 0, 1, ..."""
    ahead = group(by).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(group(by))
    return F.coalesce(F.min(F.when(column_safe(flag), F.col(at))).over(ahead), n) - F.col(at) - 1


def softmax(score: Column | str, by: Sequence[str], temperature: float = 1.0) -> Column:
    score = column_safe(score)
    e = F.exp((score - F.max(score).over(group(by))) / temperature)
    return e / F.sum(e).over(group(by))


def weighted_draw(df: DataFrame, weight: str, by: Sequence[str], *ties: str, seed: int = 0) -> DataFrame:
    """One row of each group, drawn with chances in proportion to ``weight`` (largest of log weight plus Gumbel noise). Weights of zero are never drawn."""
    noise = (F.pmod(F.xxhash64(F.lit(seed), *by, *ties), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = df.filter(F.col(weight) > 0).withColumn("__g", F.log(weight) - F.log(-F.log(noise)))
    return keep_first(drawn, by, F.col("__g").desc(), *[F.col(c) for c in ties]).drop("__g")


def terciles(df: DataFrame, value: str, by: Sequence[str], name: str = "risk") -> DataFrame:
    """low, medium, high by the sorted values at a third and at two thirds of the group."""
    rn, n = F.row_number().over(group(by).orderBy(F.col(value).asc_nulls_last())) - 1, F.count(F.lit(1)).over(group(by))
    marked = df.withColumns({"__rn": rn, "__n": n})
    cut = [F.max(F.when(F.col("__rn") == F.floor(F.col("__n") * k / 3), F.col(value))).over(group(by)) for k in (1, 2)]
    label = F.when(F.col(value) < cut[0], "low").when(F.col(value) < cut[1], "medium").otherwise("high")
    return marked.withColumn(name, label).drop("__rn", "__n")
