"""Which datasets there are, how they are grouped, how long tasks on them run side by side, and what is known of each."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldglass.functions import bytes_for_people

#: Datasets by group; the first line holds those with a file for each season.
SEASONAL = frozenset("pbp player_stats rosters schedules injuries depth_charts snap_counts ff_opportunity officials nextgen_stats team_stats participation ftn_charting rosters_weekly".split())
WHOLE = frozenset("draft_picks combine contracts ids players teams ff_rankings trades ff_playerids".split())
ESSENTIAL = frozenset("rosters team_stats draft_picks combine players teams ff_rankings trades ff_playerids".split())
LARGE = frozenset("pbp participation rosters_weekly".split())
ALL = SEASONAL | WHOLE
ANALYSIS = ALL - LARGE
GROUPS = {"essential": ESSENTIAL, "analysis": ANALYSIS, "large": LARGE, "all": ALL}
DESCRIPTIONS = {
    "essential": "quick exploration: combine, draft, rosters",
    "analysis": "all but play-by-play and other large datasets",
    "large": "datasets that take time and space",
    "all": "every dataset",
}


def describe(group: str) -> str:
    return DESCRIPTIONS.get(group, "unknown group")


def select(*groups: str, without: Iterable[str] = ()) -> frozenset[str]:
    """Union of groups less some datasets."""
    return frozenset().union(*(GROUPS[g] for g in groups)) - frozenset(without)


@dataclass
class Outcome:
    name: str
    result: object = None
    error: str | None = None


def side_by_side(tasks: dict[str, Callable[[], object]], workers: int = 8, done: Callable[[Outcome], None] | None = None) -> list[Outcome]:
    """Run independent jobs from driver threads; an error is kept as text and stops no other job. In the order they end."""
    out = []
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(tasks) or 1))) as pool:
        running = {pool.submit(f): name for name, f in tasks.items()}
        for future in as_completed(running):
            try:
                outcome = Outcome(running[future], future.result())
            except Exception as e:  # noqa: BLE001 - it is the caller's to look at
                outcome = Outcome(running[future], error=f"{type(e).__name__}: {e}")
            out.append(outcome)
            if done:
                done(outcome)
    return out


def land(spark: SparkSession, fetch: Callable[[str, int | None], DataFrame], name: str, folder: str, seasons: Iterable[int] | None = None) -> list[str]:
    """Write what ``fetch`` gives for a dataset (and each season) as CSV; the folders written."""
    if name not in ALL:
        raise KeyError(name)
    paths = []
    for season in sorted(seasons) if name in SEASONAL and seasons else [None]:
        path = os.path.join(folder, name if season is None else f"{name}_{season}")
        fetch(name, season).write.mode("overwrite").option("header", True).csv(path)
        paths.append(path)
    return paths


class Manifest:
    """Facts about datasets in one JSON file; updates merge into what is there."""

    def __init__(self, path: str, today: Callable[[], str] = lambda: datetime.date.today().isoformat()):
        self.path, self.today = path, today

    def read(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def write(self, content: dict) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        content.setdefault("metadata", {})["last_updated"] = self.today()
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(content, f, indent=2, ensure_ascii=False)

    def update(self, name: str, changes: dict, section: str = "datasets") -> None:
        content = self.read()
        entry = content[section][name]  # KeyError for an unknown one
        for k, v in changes.items():
            entry[k] = {**entry[k], **v} if isinstance(v, dict) and isinstance(entry.get(k), dict) else v
        self.write(content)

    def verify(self, name: str, **coverage) -> None:
        self.update(name, {"coverage": {"verified": True, **coverage}})

    def executives(self, files: int, on: str | None = None) -> None:
        self.update("gm_executives", {"files": files, "last_updated": on or self.today()})

    def script(self, name: str, changes: dict) -> None:
        self.update(name, changes, "transformation_scripts")

    def info(self, name: str) -> dict:
        return self.read()["datasets"][name]

    def names(self) -> list[str]:
        return list(self.read()["datasets"])

    def unverified(self) -> list[str]:
        return [n for n, d in self.read()["datasets"].items() if "coverage" in d and not d["coverage"].get("verified", False)]


def status(data_dir: str, spark: SparkSession | None = None) -> list[tuple[str, int, str]]:
    """(what, count, size) of each folder of landed files, and tables of each database."""
    out = []
    for folder, _, names in sorted(os.walk(data_dir)):
        if files := [n for n in names if n.endswith((".csv", ".parquet"))]:
            out.append((os.path.relpath(folder, data_dir), len(files), bytes_for_people(sum(os.path.getsize(os.path.join(folder, n)) for n in files))))
    if spark:
        out += [(db.name, len(spark.catalog.listTables(db.name)), "") for db in spark.catalog.listDatabases()]
    return out
