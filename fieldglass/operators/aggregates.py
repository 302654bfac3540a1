"""Aggregations: totals, recent form, shares allowed, replacement levels, data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import literal_map

#: The share of flex places that each position takes.
FLEX_SHARE = {"RB": 0.50, "WR": 0.35, "TE": 0.15}


def form(df: DataFrame, by: Sequence[str], value: str, at: str, least: int = 2) -> DataFrame:
    """Count, mean, sample deviation, best, variation (null with under ``least`` values or a mean of zero or less) and linear trend (0 with under two values)."""
    n, mean, std = F.count(F.lit(1)), F.avg(value), F.stddev_samp(value)
    return df.groupBy(*by).agg(
        n.alias("weeks_analyzed"),
        mean.alias("mean_points"),
        F.coalesce(std, F.lit(0.0)).alias("std_points"),
        F.max(value).alias("best_points"),
        F.when((n >= least) & (mean > 0), std / mean).alias("consistency_cv"),
        F.when(n >= 2, F.coalesce(F.regr_slope(value, at), F.lit(0.0))).otherwise(F.lit(0.0)).alias("trend_slope"),
    )


def both_sides(games: DataFrame, home: str, away: str, team: str = "team", opponent: str = "opponent", keep: Sequence[str] = ()) -> DataFrame:
    """Each game once for each of its teams, with the other as opponent. One pass, no union."""
    sides = F.array(F.struct(F.col(home).alias(team), F.col(away).alias(opponent)), F.struct(F.col(away).alias(team), F.col(home).alias(opponent)))
    return games.select(*keep, F.explode(sides).alias("__s")).select(*keep, f"__s.{team}", f"__s.{opponent}")


def mean_over_opponents(games: DataFrame, allowed: DataFrame, positions: Sequence[str], value: str = "allowed") -> DataFrame:
    """Mean over a team's coming games of what its opponents allow a position; an unknown opponent counts 0. ``games``: team, opponent; ``allowed``: opponent, position, value."""
    met = games.groupBy("team", "opponent").agg(F.count(F.lit(1)).alias("__n"))  # pairs of teams, however many games
    wide = met.withColumn("position", F.explode(F.array(*map(F.lit, positions))))
    joined = wide.join(allowed, ["opponent", "position"], "left")
    return joined.groupBy("team", "position").agg((F.sum(F.col("__n") * F.coalesce(value, F.lit(0.0))) / F.sum("__n")).alias("schedule_quality"))


def depth(teams: int, slots: Mapping[str, int], flex: int = 0, shares: Mapping[str, float] = FLEX_SHARE) -> dict[str, int]:
    """Players of each position that start in a league; a half is rounded to even."""
    return {p: teams * n + round(flex * teams * shares.get(p, 0.0)) for p, n in slots.items()}


def replacement_levels(pool: DataFrame, depths: Mapping[str, int], position: str = "position", value: str = "projected_points", *ties: str) -> DataFrame:
    """(position, replacement): the value just below each position's depth, 0.0 where the list is shorter.

    Only the first rows of each position are ranked: the limit on the rank is applied in every task before the shuffle.
    """
    table = literal_map(depths)
    order = Window.partitionBy(position).orderBy(F.col(value).desc_nulls_last(), *[F.col(t) for t in ties])
    ranked = pool.filter(F.col(position).isin(list(depths))).withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= max(depths.values(), default=0) + 1)
    level = F.max(F.when(F.col("__rn") == F.try_element_at(table, F.col(position)) + 1, F.col(value)))
    found = ranked.groupBy(position).agg(level.alias("replacement"))
    known = pool.sparkSession.createDataFrame([(p,) for p in depths], f"`{position}` string")
    return known.join(found, position, "left").select(position, F.coalesce("replacement", F.lit(0.0)).alias("replacement"))


def repeated_rows(df: DataFrame, *keys: str) -> DataFrame:
    """All rows whose key stands more than once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def once_only(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def coverage(df: DataFrame, column: str) -> Column:
    """Share of rows that have a value, in percent."""
    return F.avg(F.col(column).isNotNull().cast("double")) * 100


def profile(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows, distinct keys, and for each column its count, least and largest value."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(key).alias("keys"),
        *[a for c in columns for a in (F.count(c).alias(f"{c}_present"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))],
    )


def position_counts(rosters: DataFrame, owner: str, position: str, positions: Sequence[str]) -> DataFrame:
    """Owners by positions: how many of each they hold. Known positions make the pivot a single aggregation."""
    return rosters.groupBy(owner).agg(*[F.count(F.when(F.col(position) == p, True)).alias(p) for p in positions])


def id_integrity(df: DataFrame, identity: str, *ids: str) -> DataFrame:
    """For each outer id: ids that several identities share (collisions), and identities that hold several of it (splits)."""
    def clashes(a: str, b: str, name: str) -> DataFrame:
        return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.countDistinct(b).alias("n")).agg(F.count(F.when(F.col("n") > 1, True)).alias(name))

    parts = [clashes(i, identity, "collisions").crossJoin(clashes(identity, i, "splits")).select(F.lit(i).alias("id"), "collisions", "splits") for i in ids]  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side's name."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))
