import json

import pytest
from pyspark.sql import functions as F

from fieldglass.plans import athletic, identity, inseason, pool, tenure

PLAYERS = "gsis_id string, pfr_id string, display_name string, birth_date string, college_name string, position string, latest_team string, yamplayer_id string"


def players(spark, *rows):
    return spark.createDataFrame([r + (None,) * (8 - len(r)) for r in rows], PLAYERS)


def combine(spark, *rows):
    return spark.createDataFrame(list(rows), "pfr_id string, player_name string, school string")


def picks(spark, *rows):
    return spark.createDataFrame(list(rows), "pfr_player_id string, pfr_player_name string, college string")


def test_unified_players_update_then_insert(spark):
    base = players(spark, ("G1", None, "Ann Lee Jr.", "2000-01-01", "Ohio St."), ("G2", "P2", "Bob Ray", None, None), ("G3", None, None, None, "X"))
    c = combine(spark, ("P1", "ann lee", "Ohio State"), ("P2", "Robert Ray", "Boston Col."), (None, "Cy Fox", "Yale"), ("P9", None, "Z"))
    d = picks(spark, ("P1", "Ann Lee", "Ohio St."), ("P4", "Dee Orr", "Iowa St."), (None, "cy fox", "Yale"))
    got = {r.name: r for r in identity.unified_players(base, c, d).collect()}
    assert set(got) == {"Ann Lee Jr.", "Bob Ray", "Cy Fox", "Dee Orr"}
    assert got["Ann Lee Jr."].pfr_id == "P1" and got["Ann Lee Jr."].college == "Ohio State"
    assert got["Bob Ray"].college == "Boston College" and got["Dee Orr"].college == "Iowa St." and got["Dee Orr"].gsis_id is None


def test_combine_players_meet_draft_picks_by_their_colleges_normal_name(spark):
    got = identity.unified_players(players(spark), combine(spark, (None, "Zed", "Ohio St.")), picks(spark, ("P7", "Zed", "Ohio St."), (None, "Yan", "Ohio St."))).collect()
    assert sorted((r.name, r.pfr_id, r.college) for r in got) == [("Yan", None, "Ohio St."), ("Zed", "P7", "Ohio State")]


def test_mapping_is_sorted_and_duplicates_are_reported(spark):
    base = players(spark, ("G1", None, "Ann", None, None), ("G2", None, "Bob", None, None))
    m = identity.mapping_table(identity.unified_players(base, combine(spark), picks(spark)))
    ids = [r[0] for r in m.select(identity.ID).collect()]
    assert ids == sorted(ids) and identity.duplicate_ids(m.unionByName(m.limit(1))).count() == 2


def mapping(spark):
    return spark.createDataFrame(
        [("G1", "P1", "Ann Lee", "ann lee", "2000-01-01", "Ohio State", "Y1"), ("G2", "P2", "Bob Ray", "bob ray", None, None, "Y2"), ("G3", "P3", "Bob Ray", "bob ray", "1999-09-09", None, "Y3")],
        "gsis_id string, pfr_id string, name string, merge_name string, birthdate string, college string, yamplayer_id string",
    )


def ids(df, key):
    return {r[key]: r[identity.ID] for r in df.collect()}


def test_hydration_rules(spark):
    m = mapping(spark)
    stats = spark.createDataFrame([("G1", "x", 1), ("none", "Ann Lee", 2), ("none", "Bob Ray", 3), (None, None, 4)], "player_id string, player_display_name string, n int")
    assert ids(identity.hydrate("player_stats", stats, m), "n") == {1: "Y1", 2: "Y1", 3: None, 4: None}
    roster = spark.createDataFrame([("G2", "P1", "Ann Lee", "2000-01-01", 1), (None, "P3", "x", None, 2), (None, None, "bob ray", "1999-09-09", 3), (None, None, "bob ray", None, 4)], "gsis_id string, pfr_id string, full_name string, birth_date string, n int")
    assert ids(identity.hydrate("rosters", roster, m), "n") == {1: "Y2", 2: "Y3", 3: "Y3", 4: None}
    comb = spark.createDataFrame([("P9", "Ann Lee II", "Ohio St", 1), ("P2", "Ann Lee", "Ohio St", 2), (None, "Ann Lee", None, 3)], "pfr_id string, player_name string, school string, n int")
    out = identity.hydrate("combine", comb.withColumn("yamplayer_id_old", F.lit("z")), m)
    assert ids(out, "n") == {1: "Y1", 2: "Y2", 3: None} and "yamplayer_id_old" not in out.columns
    snaps = spark.createDataFrame([("P1",), ("P1",), (None,)], "pfr_player_id string")
    assert sorted(r[1] or "" for r in identity.hydrate("snap_counts", snaps, m).collect()) == ["", "Y1", "Y1"]
    report = identity.match_report(identity.hydrate_all({"snap_counts": snaps, "unknown": snaps}, m)).collect()
    assert [(r.dataset, r.rows, round(r.matched_pct, 3)) for r in report] == [("snap_counts", 3, 66.667)]


COMBINE = "player_name string, pos string, draft_year int, bench double, broad_jump double, cone double, forty double, ht string, shuttle double, vertical double, wt double"


def test_athletic_scores(spark):
    rows = [("a", "CB", 2020, 10.0, None, None, 4.4, "5-11", None, None, 190.0), ("b", "CB", 2020, 20.0, None, None, 4.6, "5-9", None, None, None), ("c", "CB/WR", 2019, None, None, None, None, None, None, None, None), ("d", "ZZ", 2020, 1.0, None, None, None, None, None, None, None), ("e", "CB", 1990, 5.0, None, None, None, None, None, None, None)]
    out = athletic.athletic_scores(spark.createDataFrame(rows, COMBINE), 2021)
    by = {(r.player_name, r.calculation_position, r.calculation_type): r for r in out.collect()}
    a, b = by["a", "CB", "historical"], by["b", "CB", "historical"]
    assert (a.forty_percentile, b.forty_percentile) == (10.0, 5.0) and (a.bench_percentile, b.bench_percentile) == (5.0, 10.0)
    assert (a.ht_percentile, b.ht_percentile) == (5.0, 10.0)  # heights rank as texts
    assert a.measurables_present == 4 and b.measurables_present == 3 and a.wt_percentile == 10.0
    c = by["c", "WR", "historical"]
    assert c.yas_score is None and c.measurables_present == 0 and ("c", "DB", "current") in by
    assert not any(k[0] == "d" for k in by) and ("e", "CB", "historical") not in by and ("e", "CB", "current") in by
    tall = {(r.player_name, r.calculation_position, r.calculation_type): r for r in athletic.athletic_scores(spark.createDataFrame(rows, COMBINE), 2021, parse_height=True).collect()}
    assert tall["a", "CB", "historical"].ht_percentile == 10.0
    assert athletic.score_leaders(out, 3).first().player_name in ("a", "b")
    years = {r.calculation_year for r in athletic.athletic_scores(spark.createDataFrame(rows, COMBINE), 2021, expanding=True).filter("player_name = 'a' AND calculation_type = 'historical'").collect()}
    assert years == {2020, 2021}


def test_percentiles_by_value_equal_the_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None)], "g string, v double")
    got = sorted((r.v or 0, r.p) for r in athletic.percentiles_by_value(df, "v", ["g"], "p").collect() if r.v)
    assert [round(p, 9) for _, p in got] == [5.0, 5.0, 10.0]


def test_tenures(spark, tmp_path):
    (tmp_path / "crd_executives.csv").write_text("Person,Teams,From,To,Titles,Notes\nAnn,ARI,2001,2004,GM,\nBob,ARI,2005,,GM,x\nCy,ARI,abc,2010,GM,\n")
    codes = spark.createDataFrame([("crd", "ARI", "Arizona Cardinals")], "pfr_code string, nflverse_code string, team_name string")
    got = {r.Person: r for r in tenure.tenures(tenure.read_executives(spark, str(tmp_path)), codes).collect()}
    assert (got["Ann"].tenure_years, got["Ann"].is_current, got["Ann"].nflverse_code) == (4, False, "ARI")
    assert got["Bob"].To is None and got["Bob"].is_current and got["Cy"].From is None
    seasons = spark.createDataFrame([("ARI", 2003), ("ARI", 2012), ("XXX", 2003)], "team string, season int")
    who = {(r.team, r.season): r.Person for r in tenure.in_charge(seasons, tenure.tenures(tenure.read_executives(spark, str(tmp_path)), codes), "team", "season").collect()}
    assert who == {("ARI", 2003): "Ann", ("ARI", 2012): "Bob", ("XXX", 2003): None}


def test_depth_charts_keep_embedded_newlines(spark, tmp_path):
    head = tenure.LEGACY + ["dt", "team", "player_name", "espn_id", "pos_grp_id", "pos_grp", "pos_id", "pos_name", "pos_abb", "pos_slot", "pos_rank"]
    line = ["2019"] + ["x"] * 12 + ['"L\nT"', "Ann"] + [""] * 11
    later = [""] * 15 + ["2025-01-01", "ARI"] + ["y"] * 9
    (tmp_path / "d.csv").write_text("\n".join(",".join(r) for r in (head, line, later, [""] * 26)) + "\n")
    old, new = tenure.split_depth_charts(tenure.read_depth_charts(spark, str(tmp_path / "d.csv")))
    assert [r.depth_position for r in old.collect()] == ["L T"] and old.columns == tenure.LEGACY
    assert [r.team for r in new.collect()] == ["ARI"] and new.columns == tenure.MODERN


def catalog(spark, projections=True):
    t = {
        "players": players(spark, ("G1", "P1", "Ann", None, None, "QB", "ARI", "Y1"), ("G2", "P2", "Bob", None, None, "RB", None, "Y2"), ("G3", "P3", "Cy", None, None, "OL", "ARI", "Y3")),
        "ff_rankings": spark.createDataFrame([("7", "Ann", "QB", "ARI", 2.5, 1.0, "ro"), ("7", "Ann", "QB", "ARI", 9.0, 1.0, "ro"), ("x", " bob ", "RB", "ATL", 1.0, None, "ro"), ("d", "Cards", "DST", "ARI", 30.0, 2.0, "ro"), ("7", "Ann", "QB", "ARI", 0.1, 1.0, "zz")], "id string, player string, pos string, team string, ecr double, sd double, ecr_type string"),
        "ff_playerids": spark.createDataFrame([("G1", "7", "S1", "Ann", "QB", "Y1"), ("G2", "8", "S2", "Bob", "RB", "Y2")], "gsis_id string, fantasypros_id string, sleeper_id string, name string, position string, yamplayer_id string"),
        "player_stats": spark.createDataFrame(STATS, STAT_COLS),
        "injuries": spark.createDataFrame([("Y1", "G1", "Out", "2024-01-02", 2024), ("Y1", "G1", "Questionable", "2024-02-02", 2023), ("Y1", "G1", None, "2024-03-02", 2024)], "yamplayer_id string, gsis_id string, report_status string, date_modified string, season int"),
        "schedules": spark.createDataFrame([(2024, 1, "REG", "ARI", "ATL"), (2024, 2, "REG", "ATL", "BAL"), (2024, 3, "REG", "ARI", "BAL"), (2024, 4, "POST", "ARI", "BAL")], "season int, week int, game_type string, home_team string, away_team string"),
        "snap_counts": spark.createDataFrame([("Y1", 2024, 1, 0.8), ("Y1", 2024, 2, 0.6)], "yamplayer_id string, season int, week int, offense_pct double"),
        "ff_opportunity": spark.createDataFrame([("G1", 2024, 1, 3.0), ("G1", 2024, 2, 1.0)], "player_id string, season int, week int, total_fantasy_points_diff double"),
    }
    if projections:
        t["ff_projections"] = spark.createDataFrame([("ann", "ARI", "QB", 333.0, 300.0, 280.0), ("Cards", "ARI", "DEF", 99.0, None, None)], "player_name string, team string, position string, fpts_ppr double, fpts_half_ppr double, fpts_std double")
    return t


STAT_COLS = "player_id string, player_display_name string, position string, team string, opponent_team string, season int, week int, season_type string, fantasy_points double, fantasy_points_ppr double, target_share double, carries double, receptions double, passing_yards double, yamplayer_id string"
STATS = [
    ("G1", "Ann", "QB", "ARI", "ATL", 2024, 1, "REG", 18.0, 20.0, None, 2.0, 0.0, 250.0, "Y1"),
    ("G1", "Ann", "QB", "ARI", "BAL", 2024, 2, "REG", 28.0, 30.0, None, 2.0, 0.0, 250.0, "Y1"),
    ("G2", "Bob", "RB", "ATL", "ARI", 2024, 1, "REG", 8.0, 10.0, 0.1, 10.0, 2.0, 0.0, "Y2"),
    ("G2", "Bob", "RB", "ATL", "ARI", 2024, 1, "POST", 99.0, 99.0, 0.1, 10.0, 2.0, 0.0, "Y2"),
]


def test_player_pool(spark):
    got = {r.player_id: r for r in pool.player_pool(catalog(spark), 2024).collect()}
    assert set(got) == {"Y1", "Y2", "DST_ARI"}
    a, b, d = got["Y1"], got["Y2"], got["DST_ARI"]
    assert (a.projected_points, a.adp, a.ecr_rank, a.injury_status, a.bye_week, a.sleeper_id) == (333.0, 2.5, 2, "Questionable", 2, "S1")
    assert (b.projected_points, b.adp, b.adp_std, b.team, b.bye_week) == (10.0, 1.0, 5.0, "FA", None)
    assert (d.position, d.projected_points, d.bye_week) == ("DEF", 99.0, 2)
    assert [r.player_id for r in pool.player_pool(catalog(spark), 2024).collect()] == ["Y2", "Y1", "DST_ARI"]
    without = {r.player_id: r.projected_points for r in pool.player_pool(catalog(spark, False), 2024, include_dst=False).collect()}
    assert without == {"Y1": 50.0, "Y2": 10.0}


def test_free_agents(spark):
    t = catalog(spark)
    got = {r.player_id: r for r in inseason.free_agents(t, 2024, 3).collect()}
    a, b = got["G1"], got["G2"]
    assert (a.weeks_analyzed, a.mean_points, a.trend_slope, a.mean_vs_expectation, a.sleeper_id) == (2, 25.0, 10.0, 2.0, "S1")
    assert b.consistency_cv is None and b.trend_slope == 0.0 and b.norm_consistency == 0.5 and b.mean_opportunity == pytest.approx(0.5 * 10 / 12)
    assert a.injury_status == "Out" and a.mean_opportunity == pytest.approx(0.35)
    only = inseason.free_agents(t, 2024, 3, "half_ppr", spark.createDataFrame([("S2",)], "sleeper_id string"), spark.createDataFrame([("S2", 7)], "sleeper_id string, count int")).collect()
    assert [(r.player_id, r.trending_adds, r.mean_points) for r in only] == [("G2", 7, 9.0)]
    assert inseason.free_agents(t, 2024, 1).count() == 0
    with pytest.raises(ValueError):
        inseason.points("other")


def test_schedule_quality_window(spark):
    t = catalog(spark)
    got = {(r.team, r.position): r.schedule_quality for r in inseason.schedule_quality(t["player_stats"], t["schedules"], 2024, 2, "ppr").collect()}
    assert got["BAL", "RB"] == 5.0 and got["BAL", "QB"] == 10.0 and got["ARI", "QB"] == 0.0


def test_rosters(spark):
    rosters = spark.createDataFrame([(["a", "b"],), (["b"],), ([],)], "players array<string>")
    known = spark.createDataFrame([("a",), ("c",)], "sleeper_id string")
    assert [r[0] for r in inseason.unrostered(known, rosters).collect()] == ["c"] and inseason.rostered(rosters).count() == 2


def test_empty_tables_give_empty_results(spark):
    t = {k: v.limit(0) for k, v in catalog(spark).items()}
    assert pool.player_pool(t, 2024).count() == 0 and inseason.free_agents(t, 2024, 5).count() == 0
    assert athletic.athletic_scores(spark.createDataFrame([], COMBINE), 2020).count() == 0
    assert json.loads("[]") == []


def test_schedules_are_met_by_pairs_of_teams(spark, rows):
    """A game that repeats is one row of the join, counted as often as it stands."""
    games = spark.createDataFrame([("A", "B")] * 300 + [("A", "C")] * 100 + [("B", None)], "team string, opponent string")
    allowed = spark.createDataFrame([("B", "QB", 8.0), ("C", "QB", 4.0)], "opponent string, position string, allowed double")
    from fieldglass.operators import mean_over_opponents

    got = mean_over_opponents(games, allowed, ["QB", "K"])
    assert rows(got) == [("A", "K", 0.0), ("A", "QB", 7.0), ("B", "K", 0.0), ("B", "QB", 0.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [team") == 2  # one below the join
