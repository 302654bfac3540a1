"""Live drafts by keyed state: picks in any order become one event each, in the draft's order, exactly once.

``fold_events`` keeps, for each draft, how many picks are folded and the picks that came too early, a state row each;
what closes a gap is folded at once with all that follows it. Replays change nothing. A gap that lasts longer than
``patience`` gives a ``waiting`` event that names the missing pick. Every folded pick gives a ``pick`` event, the last
one a ``complete`` event after it.

``EventLog`` is a sink whose tasks write files and whose driver commits a batch by one manifest, so a batch that runs
again adds nothing; ``read_events`` reads what is committed. ``Announcer`` tells subscribers, and runs the costly
recommendation beside the stream, on the user's turn only: a newer pick cancels its Spark jobs and drops its result.
``replay_then_tail`` takes history to its end and goes on from its offsets, through one checkpoint. ``draft_states``
reads the states of a checkpoint from any session.

Defined results: picks without a draft or a number, and numbers below one, change nothing; of picks with the same
number the first that is folded counts; within a batch that is the least player id. Null player ids stay null.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor
from pyspark.util import InheritableThread

from fieldglass.cluster import carried, ship_package

carried(__name__)

EVENT = "draft_id string, event string, pick_no int, round int, slot int, player_id string, current_pick int, on_the_clock int, is_complete boolean"
STATE = "draft_id string, picks int, current_pick int, on_the_clock int, is_complete boolean, rosters string"
EVENT_ROW, STATE_ROW = (Row(*[c.split()[0] for c in columns.split(", ")]) for columns in (EVENT, STATE))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snake_slot(pick: int, teams: int) -> int:
    """As in ``plans/league.py``, for workers that have this module alone."""
    back, place = divmod(pick - 1, teams)
    return teams - place if back % 2 else place + 1


class DraftFold(StatefulProcessor):
    """State of a draft: ``progress`` (picks folded), ``early`` (picks beyond a gap), and ``made`` (folded picks) where whole states are asked for."""

    def __init__(self, teams: int, rounds: int, patience_ms: int | None = None, whole: bool = False):
        self.teams, self.total, self.patience, self.whole = teams, teams * rounds, patience_ms, whole

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "folded int")
        self.early = handle.getMapState("early", "pick_no int", "player_id string")
        if self.whole:
            self.made = handle.getMapState("made", "pick_no int", "player_id string")

    def close(self) -> None:
        pass

    def folded(self) -> int:
        return self.progress.get()[0] if self.progress.exists() else 0

    def event(self, draft: str, kind: str, pick: int, player: str | None) -> Row:
        nxt = pick + (kind != "waiting")
        over = nxt > self.total
        return EVENT_ROW(draft, kind, pick, (pick - 1) // self.teams + 1, snake_slot(pick, self.teams), player, nxt, 0 if over else snake_slot(nxt, self.teams), over)

    def state(self, draft: str, folded: int) -> Row:
        rosters: dict[str, list] = {}
        for (pick,), (player,) in sorted(self.made.iterator()):
            rosters.setdefault(str(snake_slot(pick, self.teams)), []).append(player)
        over = folded >= self.total
        return STATE_ROW(draft, folded, folded + 1, 0 if over else snake_slot(folded + 1, self.teams), over, json.dumps(rosters, sort_keys=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        draft, before = key[0], self.folded()
        folded, new = before, {}
        for r in rows:
            if draft is not None and r.pick_no is not None and r.pick_no > before and (r.pick_no not in new or (r.player_id or "") < (new[r.pick_no] or "")):
                new[r.pick_no] = r.player_id
        out = []
        waited = self.early.exists() if new else False
        while True:
            nxt = folded + 1
            if waited and self.early.containsKey((nxt,)):  # it came first
                player = self.early.getValue((nxt,))[0]
                self.early.removeKey((nxt,))
                new.pop(nxt, None)
            elif nxt in new:
                player = new.pop(nxt)
            else:
                break
            folded = nxt
            if self.whole:
                self.made.updateValue((folded,), (player,))
            else:
                out.append(self.event(draft, "pick", folded, player))
                if folded == self.total:
                    out.append(self.event(draft, "complete", folded, player))
        for pick, player in new.items():
            if not (waited and self.early.containsKey((pick,))):
                self.early.updateValue((pick,), (player,))
        if folded > before:
            self.progress.update((folded,))
        if self.patience is not None and new and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        if self.whole and draft is not None:
            out.append(self.state(draft, folded))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.early.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
            if not self.whole:
                yield self.event(key[0], "waiting", self.folded() + 1, None)


def _run(picks: DataFrame, fold: DraftFold, out: str, output: str = "append") -> DataFrame:
    spark = ship_package(picks.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one store that keeps maps and timers; it holds for the session
    mode = "none" if fold.patience is None else "processingTime"
    return picks.select("draft_id", F.col("pick_no").cast("int"), "player_id").groupBy("draft_id").transformWithState(fold, out, output, mode)


def fold_events(picks: DataFrame, teams: int, rounds: int, patience: float | None = None) -> DataFrame:
    """One event for each pick of each draft, in order. ``patience``: seconds after which an open gap is named, again and again."""
    return _run(picks, DraftFold(teams, rounds, None if patience is None else int(1000 * patience)), EVENT)


def fold_states(picks: DataFrame, teams: int, rounds: int, output: str = "update") -> DataFrame:
    """The state of each draft after every batch that brought picks of it. ``output``: the stream's mode; the event log takes ``append``."""
    return _run(picks, DraftFold(teams, rounds, whole=True), STATE, output)


def with_candidates(events: DataFrame, ranked: list[str], n: int) -> DataFrame:
    """``top``: the first ``n`` of ``ranked`` that are not taken yet after each pick. ``ranked`` has the draft's pool down to picks + n, best first."""
    so_far = Window.partitionBy("draft_id").orderBy("pick_no", F.desc("event"))
    taken = F.collect_set("player_id").over(so_far)
    return events.withColumn("top", F.slice(F.array_except(F.array(*map(F.lit, ranked)), taken), 1, n))


# sink


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


class EventWriter(DataSourceStreamWriter):
    """Tasks write a file each; the batch counts once its manifest is in place. A manifest is never written twice."""

    def __init__(self, options):
        self.uri = options["path"]

    def store(self, sub: str = "") -> tuple[fs.FileSystem, str]:
        files, base = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        return files, f"{base.rstrip('/')}/{sub}".rstrip("/")

    def put(self, sub: str, name: str, text: str) -> None:
        """Whole or not at all: written aside, then moved."""
        files, folder = self.store(sub)
        files.create_dir(folder, recursive=True)
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(text.encode())
        files.move(aside, f"{folder}/{name}")

    def write(self, iterator: Iterator[Row]) -> Written:
        lines = [json.dumps(r.asDict()) for r in iterator]
        if not lines:
            return Written(None, 0)
        name = f"{uuid.uuid4().hex}.json"
        self.put("data", name, "\n".join(lines) + "\n")
        return Written(f"data/{name}", len(lines))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, done = self.store(f"committed/{batchId:012d}.json")
        if files.get_file_info(done).type == fs.FileType.NotFound:
            kept = [m for m in messages if m and m.path]
            self.put("committed", f"{batchId:012d}.json", json.dumps({"files": [m.path for m in kept], "rows": sum(m.rows for m in kept)}) + "\n")
        else:
            self.abort(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, base = self.store()
        for m in messages:
            if m and m.path and files.get_file_info(f"{base}/{m.path}").type != fs.FileType.NotFound:
                files.delete_file(f"{base}/{m.path}")


class EventLog(DataSource):
    """``writeStream.format("draft_event_log").option("path", shared folder)``."""

    @classmethod
    def name(cls) -> str:
        return "draft_event_log"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options)


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A stream writer into the log at ``path``; add a trigger and start it."""
    ship_package(events.sparkSession).dataSource.register(EventLog)
    return events.writeStream.format("draft_event_log").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Rows of committed batches, with their batch. Files of batches that never committed are not read."""
    base = path.rstrip("/")
    manifests = spark.read.schema("files array<string>, rows long").json(f"{base}/committed").select(F.explode("files").alias("file"), F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("batch"))
    rows = spark.read.schema(schema).json(f"{base}/data").withColumn("file", F.concat(F.lit("data/"), F.col("_metadata.file_name")))
    return rows.join(manifests, "file").drop("file")


def replay_then_tail(events: DataFrame, path: str, checkpoint: str, poll: float = 0.5):
    """All history there is into the log, then the running query that goes on where it ended. Start it again with the same checkpoint after a stop or loss."""
    write_events(events, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return write_events(events, path, checkpoint).trigger(processingTime=f"{max(1, round(1000 * poll))} milliseconds").start()


def draft_states(spark: SparkSession, checkpoint: str, teams: int, rounds: int) -> DataFrame:
    """draft_id, picks, current_pick, is_complete, early: each draft's state in a checkpoint, running or not, read in any session."""

    def part(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    early = part("early").groupBy(F.col("key.draft_id").alias("draft_id")).agg(F.count("*").alias("early"))
    folded = part("progress").select(F.col("key.draft_id").alias("draft_id"), F.col("value.folded").alias("picks"))
    both = folded.join(early, "draft_id", "full").select("draft_id", F.coalesce("picks", F.lit(0)).alias("picks"), F.coalesce("early", F.lit(0)).alias("early"))
    return both.select("draft_id", "picks", (F.col("picks") + 1).alias("current_pick"), (F.col("picks") >= teams * rounds).alias("is_complete"), "early")


# subscribers


class Announcer:
    """``foreachBatch`` of events for the drafts in ``follow``: emits every event once, asks for a recommendation beside the
    stream where the user is on the clock, and cancels it when a newer pick comes. Rows that reach the driver are those of
    the followed drafts, at most teams times rounds each."""

    def __init__(self, spark: SparkSession, follow: Iterable[str], emit: Callable[[dict], None], recommend: Callable[[dict], object] | None = None, user_slot: int = 1):
        self.spark, self.follow, self.emit, self.recommend, self.user_slot = spark, list(follow), emit, recommend, user_slot
        self.last: dict[str, dict] = {}
        self.asked: dict[str, int] = {}  # the pick a recommendation was last asked for
        self.running: dict[str, tuple[str, threading.Thread]] = {}
        self.lock = threading.Lock()

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        mine = events.filter(F.col("draft_id").isin(self.follow)).orderBy("draft_id", "pick_no", F.desc("event")).collect()
        for row in mine:
            event = row.asDict()
            draft = event["draft_id"]
            with self.lock:
                known = self.last.get(draft)
                if event["event"] != "waiting" and known and (event["pick_no"], event["event"] == "complete") <= (known["pick_no"], known["event"] == "complete"):
                    continue  # a batch that ran again
                if event["event"] != "waiting":
                    self.last[draft] = event
                    overtaken = self.running.pop(draft, None)
            if event["event"] != "waiting" and overtaken:
                self.spark.sparkContext.cancelJobsWithTag(overtaken[0])
            self.emit(event)
        for draft in dict.fromkeys(r.draft_id for r in mine):
            state = self.last.get(draft)
            if state and self.recommend and not state["is_complete"] and state["on_the_clock"] == self.user_slot:
                self.start(draft, state)

    def start(self, draft: str, state: dict) -> None:
        with self.lock:
            if self.asked.get(draft) == state["current_pick"] or self.last[draft]["current_pick"] != state["current_pick"]:
                return
            self.asked[draft] = state["current_pick"]
            tag = f"recommend-{uuid.uuid4().hex}"
            thread = InheritableThread(target=self.work, args=(draft, state, tag), daemon=True)
            self.running[draft] = (tag, thread)
        thread.start()

    def work(self, draft: str, state: dict, tag: str) -> None:
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setInterruptOnCancel(True)
        try:
            found = self.recommend(state)
        except Exception as e:
            with self.lock:
                overtaken = self.running.get(draft, ("",))[0] != tag
                if not overtaken:
                    self.running.pop(draft)
            if not overtaken:
                self.emit(state | {"event": "failed", "reason": str(e)})
            return
        with self.lock:
            if self.running.get(draft, ("",))[0] != tag:
                return  # a newer pick came meanwhile
            self.running.pop(draft)
        self.emit(state | {"event": "recommendations", "results": found})

    def join(self, seconds: float) -> None:
        for _, thread in list(self.running.values()):
            thread.join(seconds)
