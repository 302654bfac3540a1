import hashlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldglass import functions as fn


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("raw, key", [(" Odell Beckham Jr. ", "odell beckham"), ("Ken Walker III", "ken walker"), ("Jivan", "jivan"), ("A V", "a"), ("", "")])
def test_name_key(spark, raw, key):
    assert one(spark, fn.name_key("n"), n=raw) == key


@pytest.mark.parametrize("raw, key", [("Ohio St.", "Ohio State"), ("Boston Col", "Boston College"), ("St. Johns", "St. Johns"), (None, None)])
def test_college_key(spark, raw, key):
    assert one(spark, fn.college_key("n"), n=raw) == key


def test_identity_hash_spells_missing_ids(spark):
    line = "None|P1|Ann Lee|None|Ohio State"
    got = one(spark, fn.identity_hash("g", "p", "n", "b", "c"), g=None, p="P1", n="Ann Lee", b=None, c="Ohio St")
    assert got == "YAMP_" + hashlib.md5(line.encode()).hexdigest()[:12]
    assert one(spark, fn.identity_hash("g", "p", "n", "b", "c"), g="G", p="", n="A", b="", c=None) == "YAMP_" + hashlib.md5(b"G|A").hexdigest()[:12]


@pytest.mark.parametrize("raw, inches", [("6-2", 74), ("5-11", 71), ("tall", None), (None, None), ("6-2-1", None)])
def test_height(spark, raw, inches):
    assert one(spark, fn.height_inches("h"), h=raw) == inches


@pytest.mark.parametrize("raw, want", [("Josh Allen BUF", ("Josh Allen", "BUF")), ("Ronaldo", ("Ronaldo", "FA")), ("A J Brown  PHI", ("A J Brown", "PHI"))])
def test_team_suffix(spark, raw, want):
    name, team = fn.team_suffix("t")
    row = spark.createDataFrame([(raw,)], "t string").select(name, team).first()
    assert tuple(row) == want


@pytest.mark.parametrize("raw, want", [("2019", 2019), ("", None), ("x", None), ("2019.0", 2019), (None, None)])
def test_to_int(spark, raw, want):
    assert one(spark, fn.to_int("t"), t=raw) == want


def test_rounding_is_half_even(spark):
    assert [one(spark, fn.cast_rounded("x"), x=v) for v in (0.5, 1.5, 2.5, 3.5)] == [0, 2, 2, 4]


def test_unknown_choice_is_an_error(spark):
    with pytest.raises(ValueError):
        fn.choose({"a": F.lit(1)}, "b")


@pytest.mark.parametrize("doc, want", [('{"scoring_settings": {"rec": 1}}', "ppr"), ('{"scoring_settings": {"rec": 0.5}}', "half_ppr"), ('{"scoring_settings": {"rec": 0}}', "standard"), ("{}", "ppr")])
def test_scoring_type(spark, doc, want):
    assert one(spark, fn.json_scoring_type("d"), d=doc) == want


def test_roster_settings(spark):
    got = one(spark, fn.roster_settings("d"), d='{"settings": {"rounds": 15, "slots_wr": 3}}')
    assert (got["wr"], got["rb"], got["bench"]) == (3, 2, 5)
    assert one(spark, fn.roster_settings("d"), d='{"settings": {"slots_bn": 4}}')["bench"] == 4
    assert one(spark, fn.roster_settings("d"), d="{}")["bench"] == 6


values = st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 6).map(float))), min_size=1, max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, st.booleans())
def test_percentile_equals_pandas(spark, data, up):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "i int, g string, v double")
    got = {r.i: r.p for r in df.select("i", fn.percentile_rank("v", ["g"], up).alias("p")).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).astype({"v": float})
    want = frame.groupby("g")["v"].rank(pct=True, ascending=up) * 10
    for i, w in want.items():
        assert (got[i] is None) == (w != w) and (w != w or abs(got[i] - w) < 1e-9)


def test_minmax_constant_and_null(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None)], "g string, v double")
    assert rows(df.select(fn.minmax_within("v", ["g"]), fn.minmax_within("v", ["g"], True, 0.5))) == [(0.0, 0.5), (0.0, 1.0), (0.0, 1.0)]


def test_gap_tier_gradient(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (100, 95, 80, 78)], "g string, v double")
    out = fn.running_tier(df, ["g"], "v", "tier", 10.0).withColumns({"gap": fn.gap_to_next(["g"], "v"), "grad": fn.gradient(["g"], "v")}).orderBy(F.desc("v")).collect()
    assert [r.tier for r in out] == [1, 1, 2, 2]
    assert [r.gap for r in out] == [5.0, 15.0, 2.0, 0.0]
    assert [r.grad for r in out] == [5.0, 10.0 + 10.0, 8.5 + 13.0, 2.0]


def test_best_other_and_next_true(spark):
    df = spark.createDataFrame([(i, "a", float(v), f) for i, (v, f) in enumerate([(5, False), (9, False), (9, True), (1, False)])], "i long, g string, v double, f boolean")
    out = df.select("i", fn.best_other(["g"], "v", "i").alias("b"), fn.next_true_distance("f", "i", ["g"]).alias("d")).orderBy("i").collect()
    assert [r.b for r in out] == [9.0, 9.0, 9.0, 9.0]
    assert [r.d for r in out] == [1, 0, 1, 0]


def test_weighted_draw_follows_weights(spark):
    df = spark.range(2000).select(F.col("id").alias("g"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit(3.0).alias("w")), F.struct(F.lit(2).alias("k"), F.lit(1.0).alias("w")), F.struct(F.lit(3).alias("k"), F.lit(0.0).alias("w")))).alias("s")).select("g", "s.*")
    drawn = {r.k: r["count"] for r in fn.weighted_draw(df, "w", ["g"], "k", seed=3).groupBy("k").count().collect()}
    assert set(drawn) == {1, 2} and 1400 < drawn[1] < 1600


def test_literals_survive_quotes(spark):
    table = {"it's": "a\\b", "x": 'say "hi"'}
    df = spark.createDataFrame([("it's",), ("x",), ("other",), (None,)], "k string")
    assert [r[0] for r in df.select(fn.lookup("k", table)).collect()] == ["a\\b", 'say "hi"', "other", None]
    assert df.select(fn.lookup("k", {"x": 0.5}, F.lit(1.0)).alias("v")).dtypes == [("v", "double")]


def test_expanding_percentile_edges(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 2, 5.0), ("a", 2, None), ("a", None, 1.0), ("b", 2, 1.0)], "g string, s int, v double")
    got = sorted(map(tuple, fn.percentile_expanding(df, "v", ["g"], "s", "p").collect()), key=repr)
    assert got == sorted([("a", 1, 5.0, 0.0), ("a", 2, 7.0, 2 / 3 * 10), ("a", 2, 5.0, 0.0), ("a", 2, None, None), ("a", None, 1.0, 0.0), ("b", 2, 1.0, 0.0)], key=repr)
