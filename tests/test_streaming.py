import json

from pyspark.sql import functions as F

from fieldglass.streaming import fold, picks


def raw(n, player, position="QB", team="ARI"):
    return {"pick_no": n, "round": 1, "draft_slot": n, "picked_by": f"u{n}", "player_id": player, "metadata": {"position": position, "team": team}}


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_polled_source_emits_only_new_picks(spark, tmp_path):
    path = tmp_path / "picks.json"
    path.write_text(json.dumps([raw(1, "a"), raw(2, "b"), raw(3, "c")]))
    drain(picks.pick_stream(spark, str(path), "D", seen=2), "polled")
    assert [(r.pick_no, r.player_id, r.draft_id) for r in spark.table("polled").collect()] == [(3, "c", "D")]
    stream = picks.pick_stream(spark, str(path), "D")
    query = stream.writeStream.format("memory").queryName("growing").start()
    query.processAllAvailable()
    path.write_text(json.dumps([raw(n, p) for n, p in enumerate("abcd", 1)]))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.pick_no for r in spark.table("growing").collect()) == [1, 2, 3, 4]


def test_fold_over_landed_files(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(raw(n, p) | {"draft_id": "D"}) for n, p in ((2, "b"), (1, "a"))))
    states = []
    follower = picks.Follower(states.append, recommend=lambda s: ["x"], user_slot=2)
    query = picks.fold(picks.landed_picks(spark, str(folder)), 2, 2).writeStream.foreachBatch(follower).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (folder / "2.json").write_text("\n".join(json.dumps(raw(n, p) | {"draft_id": "D"}) for n, p in ((2, "b"), (3, "c"), (4, "d"))))
    query.processAllAvailable()
    query.stop()
    assert [s["event"] for s in states] == ["pick", "recommendations", "complete"]
    last = follower.snapshot("D")
    assert last["picks"] == 4 and last["is_complete"] and json.loads(last["rosters"]) == {"1": ["a", "d"], "2": ["b", "c"]}
    assert follower.snapshot("other") is None


def test_resolution_and_placeholders(spark):
    pool = spark.createDataFrame([("Y1", "Ann", "QB", "ARI", 300.0, "S1"), ("DST_ARI", "Cards", "DEF", "ARI", 90.0, None)], "player_id string, name string, position string, team string, projected_points double, sleeper_id string")
    rows = [("D", 1, 1, 1, "u", "S1", "QB", "ARI"), ("D", 2, 1, 2, "u", "ARI", "DEF", "ARI"), ("D", 3, 1, 3, "u", "zz", "LB", ""), ("D", 4, 1, 4, "u", "", "K", "")]
    got = {r.pick_no: r.player for r in picks.resolve_picks(spark.createDataFrame(rows, picks.PICK), pool).collect()}
    assert (got[1].player_id, got[2].player_id) == ("Y1", "DST_ARI")
    assert (got[3].player_id, got[3].position, got[3].projected_points) == ("unknown_zz", "QB", 0.0)
    assert (got[4].player_id, got[4].name) == ("unknown_K_UNK", "Unknown (K)")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.col("id") * 1.5).alias("value"), F.timestamp_seconds("id").alias("ts"))
    for i in range(3):
        rows.filter(F.col("event_id") % 3 == i).write.parquet(str(tmp_path / "in" / f"{i}"))
    (tmp_path / "c").mkdir()
    got = fold.run_available(spark, str(tmp_path / "in" / "*"), rows.schema, str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.running_totals(rows).collect()))


def test_following_ends_when_the_draft_is_complete_and_all_is_seen(spark, tmp_path):
    path = tmp_path / "picks.json"
    path.write_text(json.dumps([raw(n, p) for n, p in enumerate("ab", 1)]))
    events = []
    follower = picks.Follower(events.append)

    def finished():
        if follower.picks_seen("D") == 2:
            path.write_text(json.dumps([raw(n, p) for n, p in enumerate("abcd", 1)]))
        return follower.picks_seen("D") == 4

    picks.follow(picks.fold(picks.pick_stream(spark, str(path), "D"), 2, 2), follower, finished, str(tmp_path / "c"))
    assert [e["event"] for e in events] == ["pick", "complete"] and not spark.streams.active
