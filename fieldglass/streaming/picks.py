"""A live draft as a stream: a polled source, the fold of picks into draft states, and what follows each batch."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from fieldglass.cluster import carried, ship_package
from fieldglass.plans.league import POSITIONS
from fieldglass.streaming.drafts import fold_states

carried(__name__)

PICK = "draft_id string, pick_no int, round int, draft_slot int, picked_by string, player_id string, position string, team string"


def parse_pick(raw: dict, draft_id: str | None = None) -> tuple:
    """One pick of a document, with defaults for what it leaves out."""
    more = raw.get("metadata") or {}
    return (str(raw.get("draft_id") or draft_id or ""), int(raw["pick_no"]), int(raw.get("round") or 0), int(raw.get("draft_slot") or 0), str(raw.get("picked_by") or ""), str(raw.get("player_id") or ""), str(more.get("position") or ""), str(more.get("team") or ""))


class PickReader(SimpleDataSourceStreamReader):
    """Each poll gets the whole list; picks after the offset are new. The offset is the number of picks seen.

    With ``log``, a folder that outlives the driver, what a poll brought is written there before it is given out, and
    a range of offsets is read from there: the list may have changed since.
    """

    def __init__(self, options):
        self.location, self.draft_id, self.seen = options["location"], options.get("draft_id"), int(options.get("seen", 0))
        self.log = options.get("log") or None

    def picks(self) -> list[dict]:
        if "://" in self.location:
            with urllib.request.urlopen(self.location, timeout=10) as answer:
                return json.load(answer)
        with open(self.location, encoding="utf-8") as f:
            return json.load(f)

    def folder(self) -> tuple[fs.FileSystem, str]:
        files, base = fs.FileSystem.from_uri(self.log if ":" in self.log else f"file://{self.log}")
        files.create_dir(base, recursive=True)
        return files, base

    def logged(self) -> dict[int, int]:
        """End of what is logged, by its start."""
        files, base = self.folder()
        found = [i.base_name[:-5].split("-") for i in files.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(".json") and not i.base_name.startswith(".")]
        return {int(a): int(b) for a, b in found}

    def entry(self, start: int, end: int) -> list[dict]:
        files, base = self.folder()
        with files.open_input_stream(f"{base}/{start:09d}-{end:09d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"seen": self.seen}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["seen"]
        if self.log and (end := self.logged().get(at)):  # given out before, and perhaps not committed
            new = self.entry(at, end)
        else:
            new = self.picks()[at:]
            if self.log and new:
                files, base = self.folder()
                with files.open_output_stream(f"{base}/.{at:09d}") as out:
                    out.write(json.dumps(new).encode())
                files.move(f"{base}/.{at:09d}", f"{base}/{at:09d}-{at + len(new):09d}.json")
        return iter([parse_pick(p, self.draft_id) for p in new]), {"seen": at + len(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at, most = start["seen"], end["seen"]
        if not self.log:
            return iter([parse_pick(p, self.draft_id) for p in self.picks()[at:most]])
        ends, found = self.logged(), []
        while at < most:
            if at not in ends:
                raise RuntimeError(f"pick {at + 1} is not in the log at {self.log}")
            found += self.entry(at, ends[at])[: most - at]
            at = ends[at]
        return iter([parse_pick(p, self.draft_id) for p in found])


class PickSource(DataSource):
    """``spark.readStream.format("draft_picks").option("location", file or url)``; ``seen`` starts after a replayed history."""

    @classmethod
    def name(cls) -> str:
        return "draft_picks"

    def schema(self) -> str:
        return PICK

    def simpleStreamReader(self, schema) -> PickReader:
        return PickReader(self.options)


def pick_stream(spark: SparkSession, location: str, draft_id: str = "", seen: int = 0, log: str = "") -> DataFrame:
    ship_package(spark).dataSource.register(PickSource)
    return spark.readStream.format("draft_picks").option("location", location).option("draft_id", draft_id).option("seen", seen).option("log", log).load()


def landed_picks(spark: SparkSession, folder: str) -> DataFrame:
    """The same picks from JSON files that land in a folder."""
    raw = ship_package(spark).readStream.schema("draft_id string, pick_no int, round int, draft_slot int, picked_by string, player_id string, metadata struct<position: string, team: string>").json(folder)
    return raw.select(*[c for c in raw.columns if c != "metadata"], "metadata.position", "metadata.team")


def resolve_picks(picks: DataFrame, pool: DataFrame) -> DataFrame:
    """Picks with the pool's player: by outer id, a team defence by its team, else a placeholder without points. Works on streams."""
    known = pool.select(F.coalesce("sleeper_id", "player_id").alias("__key"), F.struct("player_id", "name", "position", "team", "projected_points").alias("__p")).dropDuplicates(["__key"])
    key = F.when(F.col("position").isin("DEF", "DST"), F.concat(F.lit("DST_"), F.col("team"))).otherwise(F.col("player_id"))
    raw = F.when(F.col("player_id") != "", F.col("player_id")).otherwise(F.concat_ws("_", "position", F.when(F.col("team") != "", F.col("team")).otherwise("UNK")))
    nobody = F.struct(
        F.concat(F.lit("unknown_"), raw).alias("player_id"), F.concat(F.lit("Unknown ("), F.when(F.col("position") != "", F.col("position")).otherwise("UNK"), F.lit(")")).alias("name"),
        F.when(F.col("position").isin(*POSITIONS), F.col("position")).otherwise("QB").alias("position"), F.when(F.col("team") != "", F.col("team")).otherwise("FA").alias("team"), F.lit(0.0).alias("projected_points"),
    )
    return picks.withColumn("__k", key).join(known, F.col("__k") == F.col("__key"), "left").withColumn("player", F.coalesce("__p", nobody)).drop("__k", "__key", "__p")


def fold(picks: DataFrame, teams: int, rounds: int) -> DataFrame:
    """The state of each draft after every batch: picks made without a gap, whose turn it is, and each slot's players."""
    return fold_states(picks, teams, rounds)


class Follower:
    """``foreachBatch`` sink: emits each batch's picks and the new states, keeps the last result for late subscribers,
    and asks for the costly recommendation once a batch, only on the user's turn; a result that is overtaken is dropped."""

    def __init__(self, emit: Callable[[dict], None], recommend: Callable[[dict], object] | None = None, user_slot: int = 1):
        self.emit, self.recommend, self.user_slot = emit, recommend, user_slot
        self.last: dict[str, dict] = {}
        self.lock = threading.Lock()

    def picks_seen(self, draft_id: str) -> int:
        with self.lock:
            return self.last.get(draft_id, {}).get("picks", 0)

    def __call__(self, states: DataFrame, batch_id: int) -> None:
        for row in states.orderBy("draft_id").toLocalIterator():  # one row for each live draft
            state = row.asDict()
            with self.lock:
                self.last[state["draft_id"]] = {"event": "complete" if state["is_complete"] else "pick", **state}
            self.emit(self.last[state["draft_id"]])
            if self.recommend and not state["is_complete"] and state["on_the_clock"] == self.user_slot:
                found = self.recommend(state)
                with self.lock:
                    if self.last[state["draft_id"]]["current_pick"] == state["current_pick"]:
                        self.last[state["draft_id"]] = {"event": "recommendations", "results": found, **state}
                        self.emit(self.last[state["draft_id"]])

    def snapshot(self, draft_id: str) -> dict | None:
        with self.lock:
            return self.last.get(draft_id)


def follow(states: DataFrame, sink: Follower, finished: Callable[[], bool], checkpoint: str, poll: float = 0.5) -> None:
    """Feed ``states`` to ``sink`` every ``poll`` seconds until ``finished`` says so: the draft is over and all its picks are seen."""
    query = states.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, round(poll * 1000))} milliseconds").start()
    try:
        while not query.awaitTermination(poll):
            if finished():
                query.processAllAvailable()
                return
    finally:
        query.stop()
