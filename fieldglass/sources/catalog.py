"""Files to catalog: views over landed files, and stored tables laid out for the filters that queries use.

Secondary indexes have no place in a scan engine: a table that is asked by season is partitioned by it, and one that is
asked by key is clustered by that key within its files, so that file statistics skip what an index would have skipped.
"""

from __future__ import annotations

import functools
import glob
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import log10_or_null, safe_identifier

SCHEMAS = ("nflverse", "reference", "yas", "raw_executives")


@dataclass(frozen=True)
class TableSpec:
    """One stored table: its logical key, whether it is mostly asked by season, has a file for each season, is only stored when asked for."""

    schema: str
    name: str
    key: tuple[str, ...] = ()
    by_season: bool = False
    seasonal: bool = False
    optional: bool = False

    @property
    def file(self) -> str:
        """Where its file lies under the data folder, without the ending."""
        return f"{self.schema}/{self.name}"


#: The tables of the catalog and their keys.
TABLES = [
    TableSpec("reference", "yamplayer_mapping", ("yamplayer_id",)),
    TableSpec("reference", "gm_tenures", ("nflverse_code", "From")),
    TableSpec("reference", "draft_values_jimmy_johnson", ("pick",)),
    TableSpec("reference", "draft_values_rich_hill", ("pick",)),
    TableSpec("reference", "draft_values_fitzgerald_spielberger", ("pick",)),
    TableSpec("reference", "draft_values_harvard", ("pick",)),
    TableSpec("reference", "team_code_mapping", ("nflverse_code",)),
    TableSpec("nflverse", "player_ids", ("gsis_id",)),
    TableSpec("nflverse", "rosters", ("gsis_id", "season", "week"), by_season=True),
    TableSpec("nflverse", "player_stats", ("player_id", "season", "week", "season_type"), by_season=True),
    TableSpec("nflverse", "combine", ("pfr_id",), by_season=True),
    TableSpec("nflverse", "draft_picks", ("season", "pick"), by_season=True),
    TableSpec("nflverse", "schedules", ("game_id",), by_season=True),
    TableSpec("nflverse", "injuries", (), by_season=True),
    TableSpec("nflverse", "pbp", ("game_id", "play_id"), by_season=True, optional=True),
    TableSpec("nflverse", "players", ("gsis_id",)),
    TableSpec("nflverse", "ff_playerids", ("gsis_id",)),
    TableSpec("nflverse", "trades", ()),
    TableSpec("nflverse", "ff_rankings", ()),
    TableSpec("nflverse", "ff_projections", ()),
    TableSpec("nflverse", "nextgen_stats", ("player_gsis_id", "season", "week", "season_type"), by_season=True, seasonal=True),
    TableSpec("nflverse", "rosters_weekly", ("gsis_id", "season", "week"), by_season=True, seasonal=True),
    TableSpec("nflverse", "ff_opportunity", ("player_id", "season", "week", "season_type"), by_season=True, seasonal=True),
    TableSpec("nflverse", "snap_counts", ("pfr_player_id", "season", "week"), by_season=True, seasonal=True),
    TableSpec("nflverse", "officials", ("official_id", "game_id"), by_season=True, seasonal=True),
    TableSpec("nflverse", "team_stats", ("season", "week", "team", "season_type"), by_season=True, seasonal=True),
    TableSpec("nflverse", "ftn_charting", ("nflverse_game_id", "nflverse_play_id"), by_season=True, seasonal=True),
    TableSpec("nflverse", "participation", ("nflverse_game_id", "play_id"), seasonal=True),
    TableSpec("yas", "yas_complete", ("yamplayer_id", "calculation_position", "calculation_type")),
]


#: Files that a season's rows are spread over.
FILES = 4


def read_csv(spark: SparkSession, path: str | Sequence[str], infer: bool = True, breaks: bool | None = None, schema: str | None = None) -> DataFrame:
    """A CSV with a header. Types are those of ``schema``, or from all of the file, or texts only; short rows are filled with nulls.

    Fields may hold line breaks where ``breaks`` says so; such a file is one task. Else files are split among tasks. Unless told,
    lines are looked through for quoted breaks first, which ends at the first one found.
    """
    options = dict(header=True, mode="PERMISSIVE", escape='"')
    if breaks is None:
        breaks = has_breaks(spark, path)
    return spark.read.csv(path, schema=schema, inferSchema=infer and schema is None, multiLine=breaks, **options)


def has_breaks(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether any line holds an odd number of quotes: then a quoted field goes on in the next line. Read as plain text, in splits."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_seasonal(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with columns of their own, united by name; what a file lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_csv(spark, p) for p in sorted(paths)])


def register_views(spark: SparkSession, data_dir: str) -> dict[str, str]:
    """A view for each CSV and Parquet file below ``data_dir``, named by its folders and file; name -> path. New files give new views."""
    if not os.path.isdir(data_dir):
        raise FileNotFoundError(data_dir)
    found = {}
    for ending in ("csv", "parquet"):
        for path in sorted(glob.glob(f"{data_dir}/**/*.{ending}", recursive=True)):
            folders = os.path.relpath(os.path.dirname(path), data_dir)
            schema = "" if folders == "." else safe_identifier("_".join(folders.split(os.sep)))
            name = "_".join(filter(None, (schema, safe_identifier(os.path.splitext(os.path.basename(path))[0]))))
            (read_csv(spark, path) if ending == "csv" else spark.read.parquet(path)).createOrReplaceTempView(f"`{name}`")
            found[name] = path
    return found


def create_schemas(spark: SparkSession, names: Sequence[str] = SCHEMAS) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{safe_identifier(name)}`")


def files_of(spec: TableSpec, data_dir: str) -> list[str]:
    """The table's file, and for seasonal ones each season's; both spellings are accepted."""
    return sorted(glob.glob(f"{data_dir}/{spec.file}.csv") + (glob.glob(f"{data_dir}/{spec.file}_[0-9]*.csv") if spec.seasonal else []))


def store_table(df: DataFrame, spec: TableSpec) -> int:
    """Write one table and return its rows."""
    by_season = "season" in df.columns and spec.by_season
    inner = [k for k in spec.key if k in df.columns and k != "season"]
    writer = df
    if by_season:
        spread = F.pmod(F.xxhash64(*(inner or df.columns)), F.lit(FILES))
        writer = writer.repartition("season", spread)  # several tasks and files for each season, however large one season is
    if inner:
        writer = writer.sortWithinPartitions(*(["season"] if by_season else []), *inner)
    out = writer.write.mode("overwrite").format("parquet")
    (out.partitionBy("season") if by_season else out).saveAsTable(f"`{spec.schema}`.`{spec.name}`")
    return df.sparkSession.table(f"`{spec.schema}`.`{spec.name}`").count()


def create_tables(spark: SparkSession, data_dir: str, include_pbp: bool = False, specs: Sequence[TableSpec] = TABLES) -> dict[str, int]:
    """Store every table whose file exists; name -> rows."""
    if not os.path.isdir(data_dir):
        raise FileNotFoundError(data_dir)
    create_schemas(spark)
    rows = {}
    for spec in specs:
        if spec.optional and not include_pbp:
            continue
        if paths := files_of(spec, data_dir):
            rows[f"{spec.schema}.{spec.name}"] = store_table(read_seasonal(spark, paths), spec)
    return rows


def has_table(spark: SparkSession, name: str) -> bool:
    try:
        return spark.catalog.tableExists(name)
    except AnalysisException:
        return False


def catalog_tables(spark: SparkSession, schema: str = "nflverse") -> dict[str, DataFrame]:
    """The stored tables of a schema, as the plans take them."""
    return {t.name: spark.table(f"`{schema}`.`{t.name}`") for t in spark.catalog.listTables(schema) if not t.isTemporary}


class CachedScan:
    """A table that is read and kept in memory until it is refreshed."""

    def __init__(self, spark: SparkSession, path: str | None):
        if not path:
            raise ValueError("a path is needed")
        self.spark, self.path, self.held = spark, path, None

    def get(self, refresh: bool = False) -> DataFrame:
        if refresh and self.held is not None:
            self.held.unpersist()
            self.held = None
        if self.held is None:
            self.held = read_csv(self.spark, self.path).cache()
        return self.held


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in each file; quotes inside fields are doubled, line breaks stay inside quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """A saved query's text, without its closing semicolon."""
    return spark.sql(text.strip().rstrip(";"))


#: Saved queries.
LEADERS = """
SELECT player_name, yas_position, draft_year, measurables_present, yas_score FROM yas.yas_complete
WHERE calculation_position = yas_position AND calculation_type = 'current' AND measurables_present >= 5
ORDER BY yas_score DESC NULLS LAST"""
#: The charts that are compared, and the number each is divided by.
CHARTS = {"fitzgerald_spielberger": 30, "harvard": 5, "jimmy_johnson": 30, "rich_hill": 10}


def value_charts(charts: dict[str, DataFrame]) -> DataFrame:
    """Draft value charts side by side on a common scale, and on a log scale; null where a log does not exist."""
    out = functools.reduce(lambda a, b: a.join(b, "pick"), [df.select("pick", (F.col("value") / CHARTS[n]).alias(f"draft_values_{n}")) for n, df in charts.items()])
    logs = {f"log_draft_values_{n}": log10_or_null(f"draft_values_{n}") * 50 for n in charts}
    return out.withColumns({"log_pick": log10_or_null("pick"), **logs})
