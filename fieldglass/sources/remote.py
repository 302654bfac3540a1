"""A service's documents as a batch source: one partition for each request, so many leagues, weeks or seasons are one DataFrame.

``spark.read.format("service_documents")`` with ``base`` (a url, or a folder that executors see and whose files have the
paths of the service and end in .json), ``name`` (a key of PATHS) and one option for each value of its path, as a comma
list: ``league_id=1,2,3``, ``week=1-17``. Rows are (the path's values as texts, document as JSON text). Filters on the values
(equal, or one of a list) are pushed into the plan: requests that they rule out are not made. A task tries again after
errors of the connection, waiting longer each time, and fails with the last one; a missing document gives no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import string
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from fieldglass.cluster import carried, ship_package
from fieldglass.sources.documents import parse, parse_draft, parse_league
from fieldglass.sources.service import DEFAULTS, PATHS

carried(__name__)

RETRIES, WAIT = 4, 0.5
#: Keys under which the reader's filters reach the plan.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def fields_of(name: str) -> list[str]:
    return [field for _, field, _, _ in string.Formatter().parse(PATHS[name][0]) if field]


def listed(text: str) -> list[str]:
    """Values of a comma list, with a-b for a range of whole numbers."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, dash, b = part.partition("-")
        out += [str(i) for i in range(int(a), int(b) + 1)] if dash and a.isdigit() and b.isdigit() else [part]
    return list(dict.fromkeys(out))


@dataclass
class Request(InputPartition):
    values: tuple[str, ...]


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.name = options["base"].rstrip("/"), options["name"]
        self.retries, self.wait = int(options.get("retries", RETRIES)), float(options.get("wait", WAIT))
        self.fields = fields_of(self.name)
        self.values = {f: listed(options.get(f) or str(DEFAULTS.get(f, ""))) for f in self.fields}
        if lacking := [f for f in self.fields if not self.values[f]]:
            raise ValueError(f"{self.name} needs {', '.join(lacking)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.values:
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[column] = [v for v in self.values[column] if v in wanted]

    def partitions(self) -> list[Request]:
        return [Request(v) for v in itertools.product(*[self.values[f] for f in self.fields])]

    def url(self, values: tuple[str, ...]) -> str:
        return f"{self.base}/" + PATHS[self.name][0].format(**{f: urllib.parse.quote(v, safe="") for f, v in zip(self.fields, values)})

    def fetch(self, url: str):
        if "://" not in url:
            path = url.partition("?")[0] + ".json"
            if not os.path.isdir(self.base):
                raise OSError(f"{self.base} can't be reached")
            if not os.path.exists(path):
                return None
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        try:
            with urllib.request.urlopen(url, timeout=10) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    def read(self, partition: Request) -> Iterator[tuple]:
        url = self.url(partition.values)
        for turn in range(self.retries + 1):
            try:
                found = self.fetch(url)
                break
            except (OSError, json.JSONDecodeError):  # connection, status and half an answer
                if turn == self.retries:
                    raise
                time.sleep(self.wait * 2**turn)
        for d in found if isinstance(found, list) else [found]:
            if d is not None:
                yield (*partition.values, json.dumps(d))


class ServiceDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "service_documents"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in [*fields_of(self.options["name"]), "value"])

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def documents_of(spark: SparkSession, base: str, name: str, **values: object) -> DataFrame:
    """Raw documents with the values of their request. ``values``: one value, a list, or a comma list for each of the path's."""
    ship_package(spark).dataSource.register(ServiceDocuments)
    spark.conf.set(PUSHDOWN, "true")  # holds for the session; without it every request is made and then filtered
    reader = spark.read.format("service_documents").option("base", base).option("name", name)
    for k, v in values.items():
        reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, (list, tuple, range)) else str(v))
    return reader.load()


def typed(raw: DataFrame, name: str) -> DataFrame:
    """The documents' columns, as ``DraftService.get`` gives them for one request."""
    kind = PATHS[name][1]
    docs = raw.select("value")
    return {"draft": parse_draft, "league": parse_league}[kind](docs) if kind in ("draft", "league") else parse(docs, kind)
