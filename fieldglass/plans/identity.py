"""One identity for each player across sources that use different ids, and its way back into those sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import college_key, identity_hash, keep_first, name_key
from fieldglass.operators import coverage, enrich, insert_missing, lookup_id_then_unique, lookup_keys, repeated_rows, tiered_match

#: Fixed value: the name of the player id in every table.
ID = "yamplayer_id"


def _source(df: DataFrame, pfr: str, name: str, college: str) -> DataFrame:
    return df.select(F.col(pfr).alias("s_pfr"), F.col(name).alias("s_name"), name_key(name).alias("s_key"), F.col(college).alias("s_college"), college_key(college).alias("s_college_key"))


def _absorb(known: DataFrame, source: DataFrame, inserted_college: str) -> DataFrame:
    """Update known players from a source, then add its players that match none of the updated ones, with that column as their college."""
    same_id = [(F.col("pfr_id"), F.col("s_pfr"))]
    same_name = [(F.col("merge_name"), F.col("s_key")), (F.col("college"), F.col("s_college_key"))]
    named = source.filter(F.col("s_name").isNotNull() & F.col("s_pfr").isNotNull())
    updated = enrich(known, named, {"pfr_id": F.col("s_pfr"), "college": F.col("s_college_key")}, [same_id, same_name], F.col("s_pfr"))
    new = source.filter(F.col("s_name").isNotNull()).select(
        F.lit(None).cast("string").alias("gsis_id"), F.col("s_pfr").alias("pfr_id"), F.col("s_name").alias("name"), F.col("s_key").alias("merge_name"),
        F.lit(None).cast("string").alias("birthdate"), F.col(inserted_college).alias("college"), F.col("s_college_key").alias("__match"),
    )
    by_id = [(F.col("pfr_id"), F.col("pfr_id"))]
    by_name = [(F.col("merge_name"), F.col("merge_name")), (F.col("__match"), F.col("college"))]
    return insert_missing(updated, new, by_id, by_name).drop("__match")


def unified_players(players: DataFrame, combine: DataFrame, draft_picks: DataFrame) -> DataFrame:
    """gsis_id, pfr_id, name, merge_name, birthdate, college of every player of three sources, each once.

    Players known from the combine alone come in with their college's normal name, those of the draft with the name as it is written.
    """
    base = players.filter(F.col("display_name").isNotNull()).select(
        "gsis_id", "pfr_id", F.col("display_name").alias("name"), name_key("display_name").alias("merge_name"), F.col("birth_date").cast("string").alias("birthdate"), college_key("college_name").alias("college")
    )
    known = _absorb(base.distinct(), _source(combine, "pfr_id", "player_name", "school"), "s_college_key")
    return _absorb(known, _source(draft_picks, "pfr_player_id", "pfr_player_name", "college"), "s_college").distinct()


def with_ids(players: DataFrame) -> DataFrame:
    return players.withColumn(ID, identity_hash("gsis_id", "pfr_id", "name", "birthdate", "college"))


def mapping_table(players: DataFrame) -> DataFrame:
    return with_ids(players).orderBy(ID)


def duplicate_ids(mapping: DataFrame) -> DataFrame:
    """Rows of ids that stand more than once: reported, not resolved."""
    return repeated_rows(mapping, ID)


def _by_gsis(column: str):
    return lambda df, m: lookup_keys(df, m, ID, (F.col(column), F.col("gsis_id")))


def _by_pfr(column: str):
    return lambda df, m: lookup_keys(df, m, ID, (F.col(column), F.col("pfr_id")))


def _by_both(gsis: str, pfr: str):
    return lambda df, m: lookup_keys(df, m, ID, (F.col(gsis), F.col("gsis_id")), (F.col(pfr), F.col("pfr_id")))


def _id_or_unique_name(gsis: str, name: str):
    return lambda df, m: lookup_id_then_unique(df, m, ID, (F.col(gsis), F.col("gsis_id")), (name_key(name), F.col("merge_name")))


def _tiers(df: DataFrame, m: DataFrame, *tiers) -> DataFrame:
    return tiered_match(df, m.select(F.col(ID), *[F.col(c).alias(f"m_{c}") for c in ("gsis_id", "pfr_id", "merge_name", "college", "birthdate")]), [ID], tiers, F.col(ID))


def _id_or_name_college(pfr: str, name: str, college: str):
    return lambda df, m: _tiers(df, m, [(F.col(pfr), F.col("m_pfr_id"))], [(name_key(name), F.col("m_merge_name")), (college_key(college), F.col("m_college"))])


def _rosters(df: DataFrame, m: DataFrame) -> DataFrame:
    born = [(F.col("birth_date").cast("string"), F.col("m_birthdate")), (name_key("full_name"), F.col("m_merge_name"))]
    return _tiers(df, m, [(F.col("gsis_id"), F.col("m_gsis_id"))], [(F.col("pfr_id"), F.col("m_pfr_id"))], born)


#: How each dataset finds its players.
HYDRATORS = {
    "combine": _id_or_name_college("pfr_id", "player_name", "school"),
    "draft_picks": _id_or_name_college("pfr_player_id", "pfr_player_name", "college"),
    "rosters": _rosters,
    "player_stats": _id_or_unique_name("player_id", "player_display_name"),
    "injuries": _id_or_unique_name("gsis_id", "full_name"),
    "depth_charts": _by_gsis("gsis_id"),
    "players": _by_gsis("gsis_id"),
    "nextgen_stats": _by_gsis("player_gsis_id"),
    "ff_opportunity": _by_gsis("player_id"),
    "rosters_weekly": _by_both("gsis_id", "pfr_id"),
    "ff_playerids": _by_both("gsis_id", "pfr_id"),
    "snap_counts": _by_pfr("pfr_player_id"),
    "trades": _by_pfr("pfr_id"),
}


def hydrate(name: str, df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``df`` with the player id, as many rows as before. Id columns of an earlier run are dropped first."""
    clean = df.drop(*[c for c in df.columns if c.startswith(ID)])
    return HYDRATORS[name](clean, mapping)


def hydrate_all(datasets: Mapping[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    return {name: hydrate(name, df, mapping) for name, df in datasets.items() if name in HYDRATORS}


def match_report(hydrated: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, rows, matched_pct)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), coverage(df, ID).alias("matched_pct")).select(F.lit(name).alias("dataset"), "rows", "matched_pct") for name, df in hydrated.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crosswalk(pfr_rows: DataFrame, ids: DataFrame, pfr: str = "pfr_id", gsis: str = "gsis_id") -> DataFrame:
    """Rows with the first gsis id of their pfr id; rows without one are kept."""
    first = keep_first(ids.filter(F.col(pfr).isNotNull() & F.col(gsis).isNotNull()).select(pfr, gsis), [pfr], F.col(gsis))
    return pfr_rows.join(first, pfr, "left")
