import random

import pytest
from pyspark.sql import functions as F

from fieldglass import functions as fn
from fieldglass.operators import ordered

ROWS = "id long, g string, v double, s int, big string"


def frame(spark, seed=0, n=400):
    """A third of all rows in one group, and a third of those of one value; null groups, values and seasons."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else rng.choice(["a", "b", None, "one" if i == 3 else "c"])
        v = 50.0 if i % 9 == 1 else None if i % 17 == 0 else float(rng.randint(0, 60))
        rows.append((i, g, v, rng.choice([1, 2, 3, 7, None]), "x"))
    return spark.createDataFrame(rows, ROWS).repartition(5)


def by_id(df, *columns):
    return {r.id: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def order():
    return [F.col("v").desc_nulls_last(), F.col("id").asc_nulls_last()]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_equal_windows(spark, parts):
    df = frame(spark, parts)
    want = fn.running_tier(df.withColumns({"position_rank": fn.place(["g"], "v", "id"), "drop": fn.gap_to_next(["g"], "v", "id")}), ["g"], "v", "tier", 3.0, "id")
    want = want.withColumn("largest", F.max("drop").over(fn.windows.group(["g"])))
    columns = ("position_rank", "drop", "tier", "largest")
    assert by_id(ordered.tiers(df, ["g"], "v", order(), 3.0, parts), *columns) == by_id(want, *columns)
    steep = df.withColumn("raw", fn.gradient(["g"], "v", "id")).withColumn("x", fn.minmax_within("raw", ["g"]))
    assert by_id(ordered.steepness(df, ["g"], "v", order(), "x", parts), "x") == by_id(steep, "x")
    up = df.withColumns({"up": fn.percentile_rank("v", ["g"]), "down": fn.percentile_rank("v", ["g"], False)})
    assert by_id(ordered.percentiles(df, "v", ["g"], "up", "down", parts=parts), "up", "down") == by_id(up, "up", "down")
    assert by_id(ordered.thirds(df, "v", ["g"], parts=parts), "risk") == by_id(fn.terciles(df, "v", ["g"]), "risk")
    assert by_id(ordered.thirds(df, "v", [], parts=parts), "risk") == by_id(fn.terciles(df, "v", []), "risk")
    spread = fn.percentile_expanding(df, "v", ["g"], "s", "x")
    assert by_id(ordered.expanding_percentiles(df, "v", ["g"], "s", "x", parts=parts), "x") == by_id(spread, "x")


def test_no_window_by_group_alone_and_no_copies_of_rows(spark):
    df = frame(spark)
    plans = [ordered.tiers(df, ["g"], "v", order(), 3.0), ordered.percentiles(df, "v", ["g"], "up"), ordered.expanding_percentiles(df, "v", ["g"], "s", "x"), ordered.thirds(df, "v", ["g"])]
    for plan in (p._jdf.queryExecution().executedPlan().toString() for p in plans):
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("__slice" in w for w in windows)
    assert "Expand" not in plans[2]._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_many_slices(spark):
    cut = ordered.slices(frame(spark, n=3000).filter("g = 'hot'"), ["g"], order(), 8)
    sizes = [r["count"] for r in cut.groupBy("__slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 2000 / 8


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    for out in (ordered.tiers(none, ["g"], "v", order(), 3.0), ordered.thirds(none, "v", ["g"]), ordered.expanding_percentiles(none, "v", ["g"], "s", "x")):
        assert out.collect() == []
