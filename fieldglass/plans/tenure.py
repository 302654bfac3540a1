"""Executive tenures, and depth charts parted by their two layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import one_line, to_int
from fieldglass.operators.intervals import range_join
from fieldglass.sources.csv_splits import read_csv_splits, read_header

#: Column order of the tenure table, and the two layouts of depth charts.
TENURE = ["Person", "pfr_team_code", "nflverse_code", "team_name", "From", "To", "tenure_years", "is_current", "Titles", "Teams", "Notes"]
LEGACY = ["season", "club_code", "week", "game_type", "depth_team", "last_name", "first_name", "football_name", "formation", "gsis_id", "jersey_number", "position", "elias_id", "depth_position", "full_name"]
#: Fields of a raw row: both layouts side by side.
WIDTH = 26
MODERN = ["dt", "team", "player_name", "gsis_id", "espn_id", "pos_grp_id", "pos_grp", "pos_id", "pos_name", "pos_abb", "pos_slot", "pos_rank"]


def read_executives(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_executives.csv`` files of a folder, with the code their name begins with. Malformed rows are left out; no file is an error."""
    rows = spark.read.csv(f"{folder.rstrip('/')}/*_executives.csv", header=True, mode="DROPMALFORMED", multiLine=True, escape='"')
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.withColumn("pfr_team_code", F.regexp_replace(name, "_executives\\.csv$", ""))


def tenures(executives: DataFrame, codes: DataFrame) -> DataFrame:
    """Years as numbers, length of tenure, whether it lasts, and the team's other code and name. An empty end means it lasts."""
    known = codes.select(F.col("pfr_code").alias("pfr_team_code"), "nflverse_code", "team_name")
    rows = executives.join(known, "pfr_team_code", "left").withColumns({"From": to_int("From"), "To": to_int("To")})
    rows = rows.withColumns({"tenure_years": F.col("To") - F.col("From") + 1, "is_current": F.col("To").isNull()})
    return rows.select(*[F.col(c) for c in TENURE if c in rows.columns])


def in_charge(seasons: DataFrame, tenure: DataFrame, team: str, season: str) -> DataFrame:
    """Who was in charge in each season of a team: terms are cut into dyadic pieces, so a season meets only the terms that hold it."""
    t = tenure.select(F.col("nflverse_code").alias("__team"), "Person", F.col("From").alias("__from"), F.coalesce("To", F.lit(9999)).alias("__to"))
    found = range_join(seasons.withColumn("__team", F.col(team)), t, ["__team"], season, "__from", "__to")
    return found.drop("__team", "__from", "__to")


def depth_chart_rows(spark: SparkSession, path: str, width: int | None = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The raw chart as texts, and (file, records, short). Fields may hold line breaks; the file is read in splits. Records of fewer than ``width`` fields are left out and counted."""
    return read_csv_splits(spark, path, width)


def read_depth_charts(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """The raw chart as texts. Records that are shorter than ``width``, or than the header if none is given, are dropped."""
    if width is None:
        width = len(read_header(spark, path))
    return depth_chart_rows(spark, path, width)[0]


def split_depth_charts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legacy, modern): rows with a season, and of the others those with a date. Two filters over one scan each; the rest is in neither."""
    season, dt = F.trim(F.coalesce("season", F.lit(""))) != "", F.trim(F.coalesce("dt", F.lit(""))) != ""
    legacy = raw.filter(season).select(*[c for c in LEGACY if c in raw.columns])
    if "depth_position" in legacy.columns:
        legacy = legacy.withColumn("depth_position", one_line("depth_position"))
    return legacy, raw.filter(~season & dt).select(*[c for c in MODERN if c in raw.columns])
