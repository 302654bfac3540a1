"""The pool of draftable players, from a season's catalog tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import cast_rounded, keep_first, latest, lower_trim
from fieldglass.operators import fallback_join, missing_pairs

log = logging.getLogger(__name__)
#: Ranking type and projection column of each scoring.
RANKING = {"ppr": "ro", "half_ppr": "ro", "standard": "ro"}
PROJECTION = {"ppr": "fpts_ppr", "half_ppr": "fpts_half_ppr", "standard": "fpts_std"}
SKILL = ["QB", "RB", "WR", "TE", "K"]
COLUMNS = ["player_id", "name", "position", "team", "projected_points", "adp", "adp_std", "bye_week", "ecr_rank", "injury_status", "sleeper_id"]


def bye_weeks(schedules: DataFrame, season: int) -> DataFrame:
    """(team, bye_week): weeks of the regular season in which a team does not play."""
    games = schedules.filter((F.col("season") == season) & (F.col("game_type") == "REG"))
    played = games.select(F.explode(F.array("home_team", "away_team")).alias("team"), "week").filter("team IS NOT NULL").distinct()
    return missing_pairs(played.select("team").distinct(), played.select("week").distinct(), played).select("team", F.col("week").alias("bye_week"))


def season_points(stats: DataFrame, season: int) -> DataFrame:
    return stats.filter((F.col("season") == season) & (F.col("season_type") == "REG")).groupBy("yamplayer_id").agg(F.sum("fantasy_points_ppr").alias("season_points"))


def latest_injury(injuries: DataFrame) -> DataFrame:
    """Last known report of each player, over all seasons."""
    known = injuries.filter(F.col("report_status").isNotNull())
    return latest(known, ["yamplayer_id"], "date_modified", "report_status").select("yamplayer_id", F.col("report_status").alias("injury_status"))


def rankings(ranks: DataFrame, ids: DataFrame, ranking: str) -> DataFrame:
    """Best rank of each player; a rank finds its player by id, and only if that fails by name and position."""
    r = ranks.filter(F.col("ecr_type") == ranking)
    by_id = ids.select(F.col("fantasypros_id").cast("string").alias("f_id"), F.col("yamplayer_id").alias("f_player"), F.col("sleeper_id").alias("f_sleeper"))
    by_name = ids.select(lower_trim("name").alias("n_key"), F.col("position").alias("n_pos"), F.col("yamplayer_id").alias("n_player"), F.col("sleeper_id").alias("n_sleeper"))
    found = fallback_join(r, by_id, F.col("id").cast("string") == F.col("f_id"), by_name, (lower_trim("player") == F.col("n_key")) & (F.col("pos") == F.col("n_pos")), "f_id")
    found = found.select(F.coalesce("f_player", "n_player").alias("yamplayer_id"), F.coalesce("f_sleeper", "n_sleeper").alias("sleeper_id"), F.col("ecr").cast("double").alias("ecr"), F.col("sd").cast("double").alias("sd"))
    found = found.filter(F.col("yamplayer_id").isNotNull())
    return keep_first(found, ["yamplayer_id"], F.col("ecr").asc_nulls_last(), F.col("sleeper_id").asc_nulls_last())


def skill_players(tables: Mapping[str, DataFrame], season: int, scoring: str = "ppr", dedupe: bool = False) -> DataFrame:
    """Ranked players at skill positions. Without a projections table, the season's points stand in. Names that repeat, repeat rows unless ``dedupe``."""
    if scoring not in RANKING:
        log.warning("unknown scoring %r, using ppr", scoring)
    ranking, column = RANKING.get(scoring, "ro"), PROJECTION.get(scoring, "fpts_ppr")
    best = rankings(tables["ff_rankings"], tables["ff_playerids"], ranking)
    out = tables["players"].filter(F.col("position").isin(SKILL)).join(best, "yamplayer_id")
    projected = F.col("season_points")
    if "ff_projections" in tables:
        names = tables["ff_playerids"].select(lower_trim("name").alias("key"), "yamplayer_id")
        projections = tables["ff_projections"].filter("position != 'DEF'").select(lower_trim("player_name").alias("key"), F.col(column).alias("projection"))
        projections = projections.join(names, "key").select("yamplayer_id", "projection")
        if dedupe:
            projections = projections.groupBy("yamplayer_id").agg(F.max("projection").alias("projection"))
        out = out.join(projections, "yamplayer_id", "left")
        projected = F.coalesce("projection", "season_points")
    out = out.join(season_points(tables["player_stats"], season), "yamplayer_id", "left").join(latest_injury(tables["injuries"]), "yamplayer_id", "left")
    out = out.join(bye_weeks(tables["schedules"], season), F.col("latest_team") == F.col("team"), "left").drop("team")
    return out.select(
        F.col("yamplayer_id").alias("player_id"), F.col("display_name").alias("name"), "position", F.col("latest_team").alias("team"), projected.alias("projected_points"),
        F.col("ecr").alias("adp"), F.col("sd").alias("adp_std"), "bye_week", cast_rounded("ecr").alias("ecr_rank"), "injury_status", "sleeper_id",
    )


def team_defences(tables: Mapping[str, DataFrame], season: int, scoring: str = "ppr") -> DataFrame:
    """One row for each ranked team defence; its projection is the full-point one whatever the scoring."""
    ranks = tables["ff_rankings"].filter((F.col("ecr_type") == RANKING.get(scoring, "ro")) & (F.col("pos") == "DST"))
    best = keep_first(ranks, ["team"], F.col("ecr").asc_nulls_last(), F.col("player")).select("team", F.col("player").alias("name"), F.col("ecr").cast("double").alias("adp"), F.col("sd").cast("double").alias("adp_std"))
    best = best.join(bye_weeks(tables["schedules"], season), "team", "left")
    points = F.lit(None).cast("double")
    if "ff_projections" in tables:
        best = best.join(tables["ff_projections"].filter("position = 'DEF'").select("team", F.col("fpts_ppr").alias("projection")), "team", "left")
        points = F.col("projection").cast("double")
    nothing = F.lit(None).cast("string")
    return best.select(
        F.concat(F.lit("DST_"), F.col("team")).alias("player_id"), "name", F.lit("DEF").alias("position"), "team", points.alias("projected_points"), "adp", "adp_std", "bye_week",
        cast_rounded("adp").alias("ecr_rank"), nothing.alias("injury_status"), nothing.alias("sleeper_id"),
    )


def player_pool(tables: Mapping[str, DataFrame], season: int, scoring: str = "ppr", include_dst: bool = True, dedupe: bool = False) -> DataFrame:
    """All draftable players by average draft position, with the defaults of a record: free agents, no points, a deviation of 5."""
    pool = skill_players(tables, season, scoring, dedupe)
    if include_dst:
        pool = pool.unionByName(team_defences(tables, season, scoring))
    filled = pool.withColumns({"team": F.coalesce("team", F.lit("FA")), "projected_points": F.coalesce("projected_points", F.lit(0.0)), "adp_std": F.coalesce("adp_std", F.lit(5.0))})
    return filled.select(*COLUMNS).orderBy(F.col("adp").asc_nulls_last(), "player_id")
