import json
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import intervals, names
from fieldglass.sources import remote


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_range_join_equals_a_scan_of_all_pairs(spark, rows, seed):
    rng = random.Random(seed)
    team = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    points = [(i, team(), rng.choice([None, rng.randint(-70, 70), rng.randint(-(2**60), 2**60)])) for i in range(120)] + [(1, "hot", 5)] * 2
    ranges = [(team(), lo, hi, k) for k in range(60) for lo in [rng.choice([None, rng.randint(-60, 60)])] for hi in [rng.choice([None, (lo or 0) + rng.randint(-3, 40), 2**60])]]
    ranges += [("a", 3, 3, 100), ("a", -(2**60), 2**60, 101), ("hot", 0, 2**59, 102)]
    p = spark.createDataFrame(points, "id long, team string, x long")
    r = spark.createDataFrame(ranges, "team string, lo long, hi long, k long")
    want = []
    for i, t, x in points:
        hits = [(i, t, x, *q[1:]) for q in ranges if None not in (t, x, *q) and q[0] == t and q[1] <= x <= q[2]]
        want += hits or [(i, t, x, None, None, None)]
    joined = intervals.range_join(p, r, ["team"], "x", "lo", "hi")
    assert rows(joined) == sorted(want, key=repr)
    assert rows(intervals.range_join(p, r, ["team"], "x", "lo", "hi", "inner")) == sorted([w for w in want if w[5] is not None], key=repr)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "<=" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_range_totals_equal_those_of_the_pairs(spark, rows, seed):
    rng = random.Random(seed)
    team = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    p = spark.createDataFrame([(i, team(), rng.choice([None, rng.randint(-70, 70)])) for i in range(200)] + [(1, "hot", 5)] * 2, "id long, team string, x long")
    ranges = [(team(), rng.choice([None, lo]), lo + rng.randint(-3, 40), rng.choice([None, k])) for k in range(80) for lo in [rng.randint(-60, 60)]]
    r = spark.createDataFrame(ranges * 2 + [("hot", -(2**60), 2**60, 7)], "team string, lo long, hi long, v long")
    want = []
    for i, t, x in map(tuple, p.collect()):
        hits = [q[3] for q in map(tuple, r.collect()) if None not in (t, x, *q[:3]) and q[0] == t and q[1] <= x <= q[2]]
        known = [v for v in hits if v is not None]
        want.append((i, t, x, len(hits) or None, sum(known) if known else None))
    got = intervals.range_totals(p, r, ["team"], "x", "lo", "hi", {"n": F.lit(1), "total": F.col("v")})
    assert rows(got) == sorted(want, key=repr)


def test_totals_make_no_pairs(spark):
    """A hundred equal points in a thousand ranges: joins see pieces and distinct points alone."""
    p = spark.range(100).select("id", F.lit("t").alias("team"), F.lit(5).alias("x"))
    r = spark.range(1000).select(F.lit("t").alias("team"), (F.col("id") % 5).alias("lo"), F.lit(9).alias("hi"))
    got = intervals.range_totals(p, r, ["team"], "x", "lo", "hi", {"n": F.lit(1)})
    assert {x.n for x in got.collect()} == {1000} and got.count() == 100


def test_range_join_of_nothing(spark):
    p, r = spark.createDataFrame([], "team string, x long"), spark.createDataFrame([], "team string, lo long, hi long")
    assert intervals.range_join(p, r, ["team"], "x", "lo", "hi").collect() == []
    assert [tuple(x) for x in intervals.range_join(spark.createDataFrame([("a", 1)], "team string, x long"), r, ["team"], "x", "lo", "hi").collect()] == [("a", 1, None, None)]


@pytest.mark.parametrize("block", [3, 1000])
def test_names_in_texts_equal_contains(spark, rows, monkeypatch, block):
    monkeypatch.setattr(names, "BLOCK_NAMES", block)
    known = ["he", "she", "hers", "his", "é日", "she", "", None, "x" * 50, "é"]
    texts = ["ushers", "", None, "é日本", "x" * 60, "nothing", "his hers"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "name string, place long")
    want = [(i, known.index(w)) for i, text in enumerate(texts) for w in {*known} - {None} if text is not None and w in text]
    found = names.names_in(t, n, "id", "text", "name", "place")
    assert rows(found) == sorted(want, key=repr)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert names.names_in(t, n.limit(0), "id", "text", "name", "place").collect() == []


def test_contained_in_takes_the_first_name(spark, rows):
    known = spark.createDataFrame([("Los Angeles Rams", "LA"), ("Los Angeles Chargers", "LAC"), ("日本", "J"), (None, "N")], "n string, code string")
    asked = spark.createDataFrame([("Los",), ("Rams",), ("",), ("日",), ("nobody",), (None,)], "raw string")
    assert rows(names.contained_in(asked, "raw", known, "n", "code", "team")) == sorted([("Los", "LAC"), ("Rams", "LA"), ("", "LAC"), ("日", "J"), ("nobody", None), (None, None)], key=repr)


@pytest.fixture
def service(tmp_path):
    for league in ("1", "2", "3"):
        folder = tmp_path / "league" / league / "matchups"
        folder.mkdir(parents=True)
        for week in (1, 2):
            (folder / f"{week}.json").write_text(json.dumps([{"roster_id": r, "matchup_id": week, "points": float(week * 10 + r)} for r in (1, 2)]))
    return tmp_path


def test_many_leagues_are_one_frame_and_filters_make_fewer_requests(spark, service):
    docs = remote.documents_of(spark, str(service), "matchups", league_id=["1", "2", "3", "9"], week="1-3")
    assert docs.count() == 12 and docs.rdd.getNumPartitions() == 12
    few = docs.filter((F.col("league_id") == "2") & F.col("week").isin("1", "2"))
    assert few.rdd.getNumPartitions() == 2 and few.count() == 4
    assert {r.points for r in remote.typed(few, "matchups").collect()} == {11.0, 12.0, 21.0, 22.0}
    assert docs.filter(F.col("value").contains('"roster_id": 1')).count() == 6
    with pytest.raises(Exception, match="league_id"):
        remote.documents_of(spark, str(service), "matchups", week=1).count()


def test_requests_are_tried_again(service, monkeypatch):
    reader = remote.DocumentReader({"base": str(service), "name": "matchups", "league_id": "1", "week": "1", "wait": "0"})
    plain, seen = reader.fetch, []

    def flaky(url):
        seen.append(url)
        if len(seen) < 3:
            raise OSError("reset")
        return plain(url)

    monkeypatch.setattr(reader, "fetch", flaky)
    assert len(list(reader.read(reader.partitions()[0]))) == 2 and len(seen) == 3
    monkeypatch.setattr(reader, "fetch", lambda url: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
    assert reader.url(("a/b", "1")).endswith("league/a%2Fb/matchups/1")
