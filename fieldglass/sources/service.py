"""A draft service's documents by name: one request, its JSON answer as typed columns."""

from __future__ import annotations

import json
import string
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.sources.documents import parse, parse_draft, parse_league

#: The service's paths, and the kind of document each answers with.
PATHS = {
    "draft": ("draft/{draft_id}", "draft"),
    "picks": ("draft/{draft_id}/picks", "pick"),
    "user": ("user/{username}", "user"),
    "user_leagues": ("user/{user_id}/leagues/nfl/{season}", "league"),
    "league": ("league/{league_id}", "league"),
    "league_rosters": ("league/{league_id}/rosters", "roster"),
    "league_users": ("league/{league_id}/users", "league_user"),
    "matchups": ("league/{league_id}/matchups/{week}", "matchup"),
    "transactions": ("league/{league_id}/transactions/{week}", "transaction"),
    "trending": ("players/nfl/trending/{kind}?lookback_hours={hours}&limit={limit}", "trending"),
    "state": ("state/nfl", "state"),
}
DEFAULTS = {"kind": "add", "hours": 24, "limit": 25}
PARSERS = {"draft": parse_draft, "league": parse_league}


def fetch_json(url: str, timeout: float = 10.0):
    """The answer's JSON; an error status or a timeout raises."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.load(answer)


class DraftService:
    """``get(name, ...)`` for each of PATHS; ``fetch`` takes a url and gives parsed JSON."""

    def __init__(self, spark: SparkSession, base: str, fetch: Callable[[str], object] = fetch_json):
        self.spark, self.base, self.fetch = spark, base.rstrip("/"), fetch

    def url(self, name: str, **values) -> str:
        path, _ = PATHS[name]
        given = DEFAULTS | values
        needed = [field for _, field, _, _ in string.Formatter().parse(path) if field]
        return f"{self.base}/" + path.format(**{k: urllib.parse.quote(str(given[k]), safe="") for k in needed})

    def get(self, name: str, **values) -> DataFrame:
        """The documents of one answer, which is a list of them or a single one; no answer gives no rows."""
        found = self.fetch(self.url(name, **values))
        rows = [(json.dumps(d),) for d in (found if isinstance(found, list) else [found]) if d is not None]
        docs = self.spark.createDataFrame(rows, "value string")
        kind = PATHS[name][1]
        return PARSERS[kind](docs) if kind in PARSERS else parse(docs, kind)

    def scoring_type(self, league_id: str) -> str:
        return self.get("league", league_id=league_id).first()["scoring_type"]

    def is_complete(self, draft_id: str, seen: int) -> bool:
        """Whether the draft has ended and all its picks are seen."""
        return self.get("draft", draft_id=draft_id).first()["status"] == "complete" and len(self.fetch(self.url("picks", draft_id=draft_id))) == seen
