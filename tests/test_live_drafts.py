import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldglass.streaming import drafts, picks

PICKS = "draft_id string, pick_no int, player_id string"


def land(spark, folder, batch, name):
    spark.createDataFrame(batch, PICKS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(PICKS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def taken(spark, tmp_path, batches, teams=3, rounds=4):
    """Events of batches, each its own micro-batch, restarted between them."""
    for k, batch in enumerate(batches):
        if batch:
            land(spark, tmp_path / "in", batch, f"b{k}")
        if batch or k == 0:
            stream = drafts.fold_events(source(spark, tmp_path / "in"), teams, rounds)
            drafts.write_events(stream, str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return drafts.read_events(spark, str(tmp_path / "log")).orderBy("draft_id", "pick_no", F.desc("event")).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_batching_gives_the_same_events(spark, tmp_path, seed):
    rng = random.Random(seed)
    all_picks = [(d, n, f"{d}{n}") for d in ("A", "B") for n in range(1, 13)]
    mixed = all_picks + rng.sample(all_picks, 8)  # replays
    rng.shuffle(mixed)
    cut = sorted(rng.sample(range(1, len(mixed)), 3))
    got = taken(spark, tmp_path, [mixed[a:b] for a, b in zip([0, *cut], [*cut, len(mixed)])])
    for d in ("A", "B"):
        mine = [r for r in got if r.draft_id == d]
        assert [(r.event, r.pick_no, r.player_id) for r in mine] == [("pick", n, f"{d}{n}") for n in range(1, 13)] + [("complete", 12, f"{d}12")]
        assert [r.slot for r in mine][:7] == [1, 2, 3, 3, 2, 1, 1] and mine[-1].is_complete and mine[-1].on_the_clock == 0
        assert all(a.batch <= b.batch for a, b in zip(mine, mine[1:]))


def test_a_gap_holds_later_picks_back_and_states_are_read_from_the_checkpoint(spark, tmp_path):
    got = taken(spark, tmp_path, [[("A", 1, "a"), ("A", 3, "c"), (None, 1, "x"), ("A", None, "y"), ("A", 0, "z"), ("B", 2, None)]])
    assert [(r.draft_id, r.pick_no) for r in got] == [("A", 1)]
    states = {r.draft_id: r for r in drafts.draft_states(spark.newSession(), str(tmp_path / "c"), 3, 4).collect()}
    assert (states["A"].picks, states["A"].early, states["A"].is_complete) == (1, 1, False) and (states["B"].picks, states["B"].early) == (0, 1)
    land(spark, tmp_path / "in", [("A", 2, "b"), ("B", 1, "q")], "late")
    got = taken(spark, tmp_path, [[]])
    assert [(r.draft_id, r.pick_no, r.player_id) for r in got] == [("A", 1, "a"), ("A", 2, "b"), ("A", 3, "c"), ("B", 1, "q"), ("B", 2, None)]
    assert {r.draft_id: (r.picks, r.early) for r in drafts.draft_states(spark, str(tmp_path / "c"), 3, 4).collect()} == {"A": (3, 0), "B": (2, 0)}


def test_states_hold_late_picks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, batch in enumerate([[1, 3], [2], [4, 5, 6]]):
        land(spark, tmp_path / "in", [("D", n, f"p{n}") for n in batch], f"b{k}")
        stream = drafts.fold_states(source(spark, tmp_path / "in"), 3, 2, "append")
        drafts.write_events(stream, str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = drafts.read_events(spark, str(tmp_path / "log"), drafts.STATE).orderBy("picks").collect()
    assert [r.picks for r in got] == [1, 3, 6] and [r.is_complete for r in got] == [False, False, True]
    assert json.loads(got[-1].rosters) == {"1": ["p1", "p6"], "2": ["p2", "p5"], "3": ["p3", "p4"]}


def test_an_open_gap_is_named(spark, tmp_path):
    land(spark, tmp_path / "in", [("A", 1, "a"), ("A", 3, "c")], "b0")
    stream = drafts.fold_events(source(spark, tmp_path / "in"), 3, 4, patience=0.2)
    query = drafts.write_events(stream, str(tmp_path / "log"), str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not any(r.event == "waiting" for r in (drafts.read_events(spark, str(tmp_path / "log")).collect() if (tmp_path / "log" / "committed").exists() else [])):
            time.sleep(0.5)
    finally:
        query.stop()
    waiting = [r for r in drafts.read_events(spark, str(tmp_path / "log")).collect() if r.event == "waiting"]
    assert waiting and (waiting[0].pick_no, waiting[0].current_pick) == (2, 2)


def test_a_batch_that_runs_again_adds_nothing(tmp_path):
    writer = drafts.EventWriter({"path": str(tmp_path)})
    row = type("R", (), {"asDict": lambda self: {"draft_id": "A"}})()
    first, again, empty = writer.write(iter([row])), writer.write(iter([row, row])), writer.write(iter([]))
    writer.commit([first, empty, None], 7)
    writer.commit([again], 7)
    assert json.loads((tmp_path / "committed" / "000000000007.json").read_text()) == {"files": [first.path], "rows": 1}
    assert [p.name for p in (tmp_path / "data").iterdir()] == [first.path[5:]]
    lost = writer.write(iter([row]))
    writer.abort([lost], 8)
    assert len(list((tmp_path / "data").iterdir())) == 1


def raw(n, player):
    return {"pick_no": n, "player_id": player, "metadata": {"position": "QB", "team": "ARI"}}


def test_history_then_tail_through_one_checkpoint(spark, tmp_path):
    path = tmp_path / "picks.json"
    path.write_text(json.dumps([raw(1, "a"), raw(2, "b")]))
    stream = lambda: drafts.fold_events(picks.pick_stream(spark, str(path), "D", log=str(tmp_path / "polled")), 2, 3)
    drafts.write_events(stream(), str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    path.write_text(json.dumps([raw(1, "changed"), raw(2, "b"), raw(3, "c")]))  # between the two, the process is gone and the list differs
    query = drafts.replay_then_tail(stream(), str(tmp_path / "log"), str(tmp_path / "c"))
    path.write_text(json.dumps([raw(1, "changed"), raw(2, "b"), raw(3, "c"), raw(4, "d")]))
    query.processAllAvailable()
    query.stop()
    got = drafts.read_events(spark, str(tmp_path / "log")).orderBy("pick_no").collect()
    assert [(r.pick_no, r.player_id) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    reader = picks.PickReader({"location": str(path), "draft_id": "D", "log": str(tmp_path / "polled")})
    assert [p[5] for p in reader.readBetweenOffsets({"seen": 0}, {"seen": 4})] == ["a", "b", "c", "d"]
    assert [p[5] for p in reader.readBetweenOffsets({"seen": 0}, {"seen": 1})] == ["a"]
    with pytest.raises(RuntimeError):
        reader.readBetweenOffsets({"seen": 9}, {"seen": 10})


def event(n, clock, done=False, kind="pick"):
    return ("D", kind, n, 1, 1, f"p{n}", n + 1, clock, done)


def test_a_newer_pick_overtakes_a_running_recommendation(spark):
    said, began = [], threading.Event()

    def recommend(state):
        began.set()
        if state["current_pick"] == 2:  # a job that would run for minutes
            return spark.range(8).repartition(2).mapInPandas(lambda it: (time.sleep(40) or x for x in it), "id long").count()
        return ["best"]

    announcer = drafts.Announcer(spark, ["D"], said.append, recommend, user_slot=1)
    frame = lambda *rows: spark.createDataFrame(list(rows) + [("other", *event(1, 1)[1:])], drafts.EVENT)
    announcer(frame(event(1, 1)), 0)
    assert began.wait(20)
    time.sleep(1)
    started = time.time()
    slow = announcer.running["D"][1]
    announcer(frame(event(1, 1), event(2, 2), event(3, 1)), 1)
    slow.join(30)
    assert not slow.is_alive() and time.time() - started < 30  # its job was cancelled
    announcer.join(20)
    announcer(frame(event(3, 1)), 1)  # the batch again
    announcer(frame(event(4, 0, True), event(4, 0, True, "complete")), 2)
    assert [(e["event"], e["pick_no"]) for e in said] == [("pick", 1), ("pick", 2), ("pick", 3), ("recommendations", 3), ("pick", 4), ("complete", 4)]
    assert announcer.last["D"]["event"] == "complete"


def test_candidates_after_each_pick(spark):
    events = spark.createDataFrame([event(1, 2), event(2, 1), event(2, 1, True, "complete")], drafts.EVENT)
    got = drafts.with_candidates(events, ["p1", "x", "p2", "y"], 2).orderBy("pick_no", F.desc("event")).collect()
    assert [r.top for r in got] == [["x", "p2"], ["x", "y"], ["x", "y"]]
