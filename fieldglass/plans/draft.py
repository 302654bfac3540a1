"""Ranking players for a pick: value over replacement, value over the next one, scarcity, need, lineups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import lookup, minmax_by, terciles, top_k
from fieldglass.operators import depth, ordered, replacement_levels
from fieldglass.plans.league import League, RosterConfig

ID, POINTS = "player_id", "projected_points"


@dataclass(frozen=True)
class Weights:
    vor: float = 0.40
    vona: float = 0.30
    scarcity: float = 0.20
    need: float = 0.10


def levels(pool: DataFrame, league: League, shares: Mapping[str, float] | None = None, position: str = "position", value: str = POINTS) -> DataFrame:
    depths = depth(league.team_count, league.roster.slots, league.roster.flex, **({"shares": shares} if shares else {}))
    return replacement_levels(pool, depths, position, value, ID)


def value_over_replacement(pool: DataFrame, replacement: DataFrame, position: str = "position", value: str = POINTS) -> DataFrame:
    """``pool`` with vor; positions without a level count from 0."""
    return pool.join(replacement, position, "left").withColumn("vor", F.col(value) - F.coalesce("replacement", F.lit(0.0)))  # its measured size decides how it is joined


def survivors(pool: DataFrame, taken: int, adp: str = "adp") -> DataFrame:
    """Without the ``taken`` players of the lowest average draft position. A top-k and an anti join, no global sort."""
    gone = pool.orderBy(F.col(adp).asc_nulls_last(), ID).limit(taken).select(ID)
    return pool.join(gone, ID, "left_anti")


def value_over_next(pool: DataFrame, taken: int, roster: RosterConfig | None = None, counts: Mapping[str, int] | None = None, position: str = "position", value: str = POINTS) -> DataFrame:
    """``pool`` with vona: points above the best other player left at the positions that compare, when ``taken`` picks have passed.

    A flex-eligible position whose own places are full compares with all flex positions. Only the two best of each group are joined.
    """
    left = survivors(pool, taken)
    roster, counts = roster or RosterConfig(flex=0), counts or {}
    flexed = [p for p in roster.flex_eligible if roster.flex > 0 and counts.get(p, 0) >= roster.slots.get(p, 0)]
    group = F.when(F.col(position).isin(flexed), F.lit("*flex")).otherwise(F.col(position)) if flexed else F.col(position)
    members = F.array(F.col(position), F.lit("*flex"))
    in_flex = F.col(position).isin(list(roster.flex_eligible))
    spread = left.select(ID, value, F.explode(F.when(in_flex, members).otherwise(F.array(F.col(position)))).alias("__g")) if flexed else left.select(ID, value, F.col(position).alias("__g"))
    best = top_k(spread, 2, ["__g"], F.col(value).desc_nulls_last(), F.col(ID))
    best = best.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(ID).alias("id"))), False).alias("__best"))  # two at most
    out = pool.withColumn("__group", group).join(best, F.col("__group") == F.col("__g"), "left")  # one row for each group, broadcast if these are few
    other = F.filter("__best", lambda b: b["id"] != F.col(ID))
    baseline = F.when(F.size(other) > 0, F.array_max(F.transform(other, lambda b: b["v"])))
    return out.withColumn("vona", F.col(value) - F.coalesce(baseline, F.lit(0.0))).drop("__group", "__g", "__best")


def by_points(value: str) -> list[Column]:
    return [F.col(value).desc_nulls_last(), F.col(ID).asc_nulls_last()]


def tier_scarcity(pool: DataFrame, threshold: float = 10.0, position: str = "position", value: str = POINTS) -> DataFrame:
    """rank, drop to the next, score (drop over the largest), tier."""
    out = ordered.tiers(pool, [position], value, by_points(value), threshold)
    return out.withColumn("scarcity", F.col("drop") / F.when(F.col("largest") > 0, F.col("largest")).otherwise(1.0)).drop("largest")


def gradient_scarcity(pool: DataFrame, position: str = "position", value: str = POINTS) -> DataFrame:
    """rank and scarcity: slope plus absolute curvature of the sorted values, scaled within the position."""
    return ordered.steepness(pool, [position], value, by_points(value), "scarcity")


def need_with_depth(roster: RosterConfig, counts: Mapping[str, int]) -> dict[str, float]:
    """Need of the scorer: flex positions and quarterbacks want one player beyond their places."""
    wanted = dict(roster.slots)
    for p in set(roster.flex_eligible) | ({"QB"} if roster.qb > 0 else set()):
        wanted[p] = wanted.get(p, 0) + 1
    return {p: max(0.0, 1 - counts.get(p, 0) / n) if n else 0.0 for p, n in wanted.items()}


def need_of_slots(roster: RosterConfig, counts: Mapping[str, int]) -> dict[str, float]:
    """Need of the simulation: the unfilled share of a position's own places."""
    return {p: max(0.0, n - counts.get(p, 0)) / max(n, 1) for p, n in roster.slots.items()}


def need_with_floor(roster: RosterConfig, counts: Mapping[str, int], floor: float = 0.15) -> dict[str, float]:
    """Need of the pick model: never under a floor, which is also that of positions without places."""
    return {p: max(floor, x) if roster.slots[p] else floor for p, x in need_of_slots(roster, counts).items()}


def draft_scores(pool: DataFrame, league: League, taken: int, counts: Mapping[str, int] | None = None, weights: Weights = Weights(), replacement: DataFrame | None = None) -> DataFrame:
    """All available players with vor, vona, scarcity, need and their weighted total, best first."""
    counts = counts or {}
    scored = value_over_replacement(pool, replacement if replacement is not None else levels(pool, league))
    scored = gradient_scarcity(value_over_next(scored, taken, league.roster, counts))
    scored = scored.withColumn("need", lookup("position", {p: float(x) for p, x in need_with_depth(league.roster, counts).items()}, F.lit(0.0)))
    scored = minmax_by(scored, [], {"vor_norm": ("vor", False, None), "vona_norm": ("vona", False, None)})
    total = weights.vor * F.col("vor_norm") + weights.vona * F.col("vona_norm") + weights.scarcity * F.col("scarcity") + weights.need * F.col("need")
    return scored.withColumn("total_score", total).orderBy(F.desc("total_score"), ID)


def best_candidates(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("total_score"), ID).limit(n)


def lineup(players: DataFrame, roster: RosterConfig, by: Sequence[str] = (), position: str = "position", value: str = POINTS) -> DataFrame:
    """``players`` with their place: a position's best in its own places, then the best of the rest in flex, else bench."""
    by, order = list(by), by_points(value)
    places = lookup(position, {p: n for p, n in roster.slots.items()}, F.lit(0)).cast("int")
    seated = ordered.numbered(players, [*by, position], order, "__place").withColumn("__own", F.col("__place") <= places)
    open_: Column = ~F.col("__own") & F.col(position).isin(list(roster.flex_eligible))
    ranked = ordered.numbered(seated.withColumn("__flex", F.coalesce(open_, F.lit(False))), [*by, "__flex"], order, "__rank")
    seat = F.when(F.col("__own"), F.col(position)).when(F.col("__flex") & (F.col("__rank") <= roster.flex), F.lit("FLEX")).otherwise("BENCH")
    return ranked.withColumn("seat", seat).drop("__own", "__flex", "__place", "__rank")


def lineup_points(players: DataFrame, roster: RosterConfig, by: Sequence[str], position: str = "position", value: str = POINTS) -> DataFrame:
    """Points of the starters of each roster."""
    return lineup(players, roster, by, position, value).groupBy(*by).agg(F.sum(F.when(F.col("seat") != "BENCH", F.col(value)).otherwise(0.0)).alias("total_points"))


def recommendations(scored: DataFrame, simulated: DataFrame) -> DataFrame:
    """Simulated candidates with the parts of their score, best mean first, with a risk label over their deviations."""
    parts = scored.select(ID, "name", "position", "vor", "vona", "scarcity", "need", "total_score")
    return terciles(simulated.join(parts, ID), "std_score", []).orderBy(F.desc("mean_score"), ID)
