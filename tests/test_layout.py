import random

from pyspark.sql import functions as F

from fieldglass.sources import layout


def test_a_lookup_by_any_column_reads_few_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"id-{rng.randint(0, 10**6):07d}", rng.randint(1990, 2025), f"n{rng.randint(0, 500):03d}", i) for i in range(8000)]
    rows += [(None, None, None, -1), ("id-x", 2000, None, -2)]
    df = spark.createDataFrame(rows, "gsis_id string, season int, name string, k int")
    df.repartition(16).write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    stored = layout.store_for_lookup(df, str(tmp_path / "z"), ["gsis_id", "season", "name"], ["gsis_id"], files=64, distinct_ids=1000)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(rows, key=repr)
    for want in (F.col("gsis_id") == rows[17][0], F.col("season") == 2003, F.col("name") == "n123"):
        assert sorted(map(tuple, stored.filter(want).collect())) == sorted(map(tuple, plain.filter(want).collect()))
        before, after = layout.rows_scanned(plain.filter(want)), layout.rows_scanned(stored.filter(want))
        assert before >= 5000 and after <= before / 2, (before, after)
    assert layout.rows_scanned(stored.filter(F.col("gsis_id") == rows[17][0])) <= 2 * 8000 / 64
    absent = F.col("gsis_id") == rows[17][0] + "!"  # between the ends of a file: the Bloom filter rules it out
    assert layout.rows_scanned(stored.filter(absent)) == 0 and layout.rows_scanned(plain.filter(absent)) >= 7500


def test_interleaving_and_cuts(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).alias("b"))
    z = {(r.a, r.b): r.z for r in df.withColumn("z", layout.interleaved([F.col("a"), F.col("b")], 3)).collect()}
    assert z[(0, 0)] == 0 and z[(7, 7)] == 63 and z[(1, 0)] == 2 and z[(0, 1)] == 1 and len(set(z.values())) == 64
    cuts = layout.cut_points(df, "a", 2)
    assert cuts == sorted(cuts) and len(cuts) <= 3
    assert layout.cut_points(df.limit(0), "a") == []


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b int")
    assert layout.store_for_lookup(none, str(tmp_path / "e"), ["a", "b"], ["a"]).collect() == []
