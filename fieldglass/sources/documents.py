"""Semi-structured sources: JSON documents of a draft service, and tables in HTML pages."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.cluster import ship_package
from fieldglass.operators.names import contained_in
from fieldglass.functions import json_scoring_type, roster_settings, team_suffix

#: Schemas of the service's documents.
SCHEMAS = {
    "draft": "draft_id string, league_id string, type string, status string, season string, draft_order map<string, int>, settings map<string, int>",
    "pick": "pick_no int, round int, draft_slot int, picked_by string, player_id string, metadata struct<position: string, team: string>",
    "user": "user_id string, username string, display_name string",
    "league": "league_id string, name string, season string, status string, total_rosters int, draft_id string, scoring_settings map<string, double>, roster_positions array<string>",
    "roster": "roster_id int, owner_id string, players array<string>, starters array<string>, reserve array<string>",
    "league_user": "user_id string, display_name string, metadata struct<team_name: string>",
    "matchup": "matchup_id int, roster_id int, points double, players array<string>, starters array<string>, players_points map<string, double>",
    "transaction": "transaction_id string, type string, status string, leg int, roster_ids array<int>, adds map<string, int>, drops map<string, int>, created long",
    "trending": "player_id string, count int",
    "state": "week int, season string, season_type string, display_week int",
}
EMPTY_LISTS = {"roster": ("players", "starters", "reserve"), "matchup": ("players", "starters"), "transaction": ("roster_ids",), "league": ("roster_positions",)}


def parse(docs: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Documents (one JSON text each) as typed columns; lists that a document leaves out are empty."""
    out = docs.select(*[c for c in docs.columns if c != column], F.from_json(column, SCHEMAS[kind]).alias("__d")).select(*[c for c in docs.columns if c != column], "__d.*")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<int>" if c == "roster_ids" else "array<string>")) for c in EMPTY_LISTS.get(kind, ())})


def parse_league(docs: DataFrame, column: str = "value") -> DataFrame:
    """League documents with their kind of scoring."""
    return parse(docs.withColumn("scoring_type", json_scoring_type(column)), "league", column)


def parse_draft(docs: DataFrame, column: str = "value") -> DataFrame:
    """Draft documents with their roster slots."""
    return parse(docs.withColumn("roster", roster_settings(column)), "draft", column)


def order_of_first_round(picks: DataFrame) -> DataFrame:
    """(draft_id, draft_order): manager -> slot, for drafts whose document has no order."""
    first = picks.filter((F.col("round") == 1) & (F.col("picked_by") != ""))
    return first.groupBy("draft_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("picked_by", "draft_slot")))).alias("draft_order"))


class _Tables(html.parser.HTMLParser):
    """Rows of text cells of every table of a page; a nested table counts to its outer cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(page: str | None, wanted: tuple[str, ...]) -> list[dict[str, str]]:
    """Rows of the first table with a header that has the ``wanted`` columns (its last header row, if there are two)."""
    reader = _Tables()
    reader.feed(page or "")
    for rows in reader.tables:
        heads = [i for i, r in enumerate(rows[:2]) if set(wanted) <= set(r)]
        if heads:
            names = rows[heads[-1]]
            return [dict(zip(names, r)) for r in rows[heads[-1] + 1 :] if len(r) == len(names)]
    return []


def html_tables(pages: DataFrame, wanted: tuple[str, ...], key: str = "page_id", column: str = "html", parts: int | None = None) -> DataFrame:
    """(key, row, cells map) of the first fitting table of each page. Pages arrive in Arrow batches; a page without one gives no rows.

    Parsing takes far longer than reading, and a file of some megabytes is one task's to read, so pages are first dealt out over ``parts`` tasks.
    """
    spark = ship_package(pages.sparkSession)
    parts = parts or max(4 * spark.sparkContext.defaultParallelism, 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, found = [], [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                for i, cells in enumerate(table_rows(page, wanted)):
                    at.append(k)
                    places.append(i)
                    found.append(list(cells.items()))
            cells = pa.array(found, pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), cells], names=[key, "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).repartition(parts).mapInArrow(run, f"`{key}` {kind}, row int, cells map<string, string>")


def projections(pages: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """player_name, team, position, fpts from projection pages (page_id, position, html). Rows without a number are left out.

    A team defence is the team whose full name holds the cell's text, the first by name; without one it has no team.
    """

    def numbers(of: DataFrame) -> DataFrame:
        rows = html_tables(of.filter(F.col("page_id").isNotNull()).select("position", "html"), ("Player", "FPTS"), "position")
        return rows.select("position", F.col("cells")["Player"].alias("raw"), F.replace(F.col("cells")["FPTS"], F.lit(","), F.lit("")).try_cast("double").alias("fpts")).filter(F.col("fpts").isNotNull())

    name, team = team_suffix("raw")
    skill = numbers(pages.filter("position != 'DEF'")).select(name.alias("player_name"), team.alias("team"), "position", "fpts")  # each page is parsed once, on one of the sides
    if codes is None:
        return skill
    dst = contained_in(numbers(pages.filter("position = 'DEF'")).select("raw", "position", "fpts").distinct(), "raw", codes, "team_name", "nflverse_code", "team")  # 32 teams
    return skill.unionByName(dst.select(F.col("raw").alias("player_name"), F.coalesce("team", F.lit("FA")).alias("team"), "position", "fpts"))


def page_facts(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, lang, title, links of pages: plain expressions, no parser."""

    def group(pattern: str) -> Column:
        return F.regexp_extract(column, pattern, 1)

    return pages.select("page_id", group('<html lang="([^"]*)"').alias("lang"), group("(?s)<title>(.*?)</title>").alias("title"), F.regexp_count(column, F.lit('<a href="')).cast("bigint").alias("links"))
