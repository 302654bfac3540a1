"""Free agents in season: six parts, scaled within the position, and their weighted sum."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import choose, latest, minmax_by, ratio_or_null
from fieldglass.operators import both_sides, form, mean_over_opponents
from fieldglass.shared import written

POSITIONS = ["QB", "RB", "WR", "TE", "K"]


@dataclass(frozen=True)
class FreeAgentWeights:
    recent: float = 0.30
    consistency: float = 0.25
    vs_expectation: float = 0.20
    opportunity: float = 0.10
    trend: float = 0.10
    schedule: float = 0.05


def points(scoring: str) -> Column:
    half = F.coalesce("fantasy_points", F.lit(0.0)) + 0.5 * F.coalesce("receptions", F.lit(0.0))
    return choose({"ppr": "fantasy_points_ppr", "standard": "fantasy_points", "half_ppr": half}, scoring)


def weekly(stats: DataFrame, season: int, start: int, end: int, scoring: str) -> DataFrame:
    """One row for each player and week of the window; of repeated rows the largest values."""
    value = points(scoring)
    rows = stats.filter((F.col("season") == season) & (F.col("season_type") == "REG") & F.col("week").between(start, end) & F.col("position").isin(POSITIONS) & value.isNotNull())
    rush = ratio_or_null(F.col("carries"), F.col("carries") + F.col("receptions") + F.col("passing_yards") / 10)
    return rows.groupBy("player_id", "week").agg(
        F.max("player_display_name").alias("player_name"), F.max("position").alias("position"), F.max("team").alias("team"), F.max("yamplayer_id").alias("yamplayer_id"),
        F.max(F.coalesce(value, F.lit(0.0))).alias("fpts"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce(rush, F.lit(0.0))).alias("rush_share"),
    )


def recent_form(stats: DataFrame, snaps: DataFrame, season: int, start: int, end: int, scoring: str) -> DataFrame:
    rows = weekly(stats, season, start, end, scoring)
    who = rows.groupBy("player_id").agg(
        *[F.max(c).alias(c) for c in ("player_name", "position", "team", "yamplayer_id")], F.avg("target_share").alias("target_share"), F.avg("rush_share").alias("rush_share")
    )
    share = snaps.filter((F.col("season") == season) & F.col("week").between(start, end)).groupBy("yamplayer_id").agg(F.avg("offense_pct").alias("snap_share"))
    out = form(rows, ["player_id"], "fpts", "week").join(who, "player_id").join(share, "yamplayer_id", "left")
    volume = F.when(F.col("position") == "RB", F.col("rush_share")).otherwise(F.col("target_share"))
    return out.withColumn("mean_opportunity", 0.5 * F.coalesce("snap_share", F.lit(0.0)) + 0.5 * volume).drop("snap_share", "target_share", "rush_share")


def against_expectation(opportunity: DataFrame, season: int, start: int, end: int) -> DataFrame:
    return opportunity.filter((F.col("season") == season) & F.col("week").between(start, end)).groupBy("player_id").agg(F.avg("total_fantasy_points_diff").alias("mean_vs_expectation"))


def points_allowed(stats: DataFrame, season: int, before: int, scoring: str) -> DataFrame:
    """(opponent, position, allowed): mean points a defence has given up in completed weeks."""
    value = points(scoring)
    rows = stats.filter((F.col("season") == season) & (F.col("season_type") == "REG") & (F.col("week") < before) & F.col("position").isin(POSITIONS) & value.isNotNull() & F.col("opponent_team").isNotNull())
    return rows.groupBy(F.col("opponent_team").alias("opponent"), "position").agg(F.avg(value).alias("allowed"))


def schedule_quality(stats: DataFrame, schedules: DataFrame, season: int, week: int, scoring: str, ahead: int = 3) -> DataFrame:
    """(team, position, schedule_quality) over weeks ``week`` to ``week + ahead``."""
    coming = schedules.filter((F.col("season") == season) & (F.col("game_type") == "REG") & F.col("week").between(week, week + ahead))
    return mean_over_opponents(both_sides(coming, "home_team", "away_team"), points_allowed(stats, season, week, scoring), POSITIONS)


def season_injuries(injuries: DataFrame, season: int) -> DataFrame:
    known = injuries.filter((F.col("season") == season) & F.col("report_status").isNotNull())
    return latest(known, ["gsis_id"], "date_modified", "report_status").select(F.col("gsis_id").alias("player_id"), F.col("report_status").alias("injury_status"))


def player_ids(ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """(player_id, sleeper_id, ecr_rank)."""
    season_long = ranks.filter(F.col("ecr_type") == "ro").select(F.col("id").cast("string").alias("__id"), F.col("ecr").alias("ecr_rank"))
    return ids.filter(F.col("gsis_id").isNotNull()).join(season_long, F.col("fantasypros_id").cast("string") == F.col("__id"), "left").select(F.col("gsis_id").alias("player_id"), "sleeper_id", "ecr_rank")


def blend(df: DataFrame, weights: FreeAgentWeights = FreeAgentWeights(), by: str = "position") -> DataFrame:
    """Six norms within ``by``, and their weighted sum. Less variation is better; without a variation a player stands in the middle."""
    norms = {
        "norm_recent": ("mean_points", False, 0.0),
        "norm_consistency": ("consistency_cv", True, 0.5),
        "norm_vs_expectation": ("mean_vs_expectation", False, 0.0),
        "norm_opportunity": ("mean_opportunity", False, 0.0),
        "norm_trend": ("trend_slope", False, 0.0),
        "norm_schedule": ("schedule_quality", False, 0.0),
    }
    parts = [weights.recent, weights.consistency, weights.vs_expectation, weights.opportunity, weights.trend, weights.schedule]
    total = sum((w * F.col(n) for w, n in zip(parts[1:], list(norms)[1:])), parts[0] * F.col("norm_recent"))
    return minmax_by(df, [by], norms).withColumn("composite", total)


def free_agents(
    tables: Mapping[str, DataFrame], season: int, week: int, scoring: str = "ppr", available: DataFrame | None = None, trending: DataFrame | None = None,
    weights: FreeAgentWeights = FreeAgentWeights(), lookback: int = 4, ahead: int = 3, dedupe: bool = False,
) -> DataFrame:
    """Scored players, best first; only those of ``available`` (sleeper_id), which then set the scale. All but the scales and the order is written once.

    Before the second week there is nothing to look back on: the result is empty.
    """
    start, end = max(1, week - lookback), week - 1
    stats = tables["player_stats"]
    out = recent_form(stats, tables["snap_counts"], season, start, end, scoring)
    ids = player_ids(tables["ff_playerids"], tables["ff_rankings"])
    if dedupe:
        ids = ids.groupBy("player_id").agg(F.max("sleeper_id").alias("sleeper_id"), F.min("ecr_rank").alias("ecr_rank"))
    out = out.join(against_expectation(tables["ff_opportunity"], season, start, end), "player_id", "left").join(ids, "player_id", "left").join(season_injuries(tables["injuries"], season), "player_id", "left")
    out = out.withColumn("mean_vs_expectation", F.coalesce("mean_vs_expectation", F.lit(0.0)))
    out = out.join(schedule_quality(stats, tables["schedules"], season, week, scoring, ahead), ["team", "position"], "left").withColumn("schedule_quality", F.coalesce("schedule_quality", F.lit(0.0)))
    if available is not None:
        out = out.join(available.select("sleeper_id").distinct(), "sleeper_id", "left_semi")
    if end < start:
        out = out.limit(0)
    out = blend(written(out, "scored"), weights)  # read twice: for the scales and for the rows
    adds = trending.select("sleeper_id", F.col("count").alias("trending_adds")) if trending is not None else None
    out = out.join(adds, "sleeper_id", "left") if adds is not None else out.withColumn("trending_adds", F.lit(0))
    return out.withColumn("trending_adds", F.coalesce("trending_adds", F.lit(0))).orderBy(F.desc("composite"), "player_id")


def rostered(rosters: DataFrame, players: str = "players") -> DataFrame:
    """(sleeper_id) of all players on any roster."""
    return rosters.select(F.explode(players).alias("sleeper_id")).distinct()


def unrostered(known: DataFrame, rosters: DataFrame) -> DataFrame:
    return known.select("sleeper_id").distinct().join(rostered(rosters), "sleeper_id", "left_anti")
