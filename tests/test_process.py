import pytest

from fieldglass.__main__ import main
from fieldglass.plans import process
from fieldglass.plans.league import League, Manager, RosterConfig
from fieldglass.plans.session import DraftSession


@pytest.fixture
def data(tmp_path):
    for folder in ("nflverse", "reference", "raw/executives"):
        (tmp_path / folder).mkdir(parents=True)
    n = tmp_path / "nflverse"
    (n / "players.csv").write_text("gsis_id,pfr_id,display_name,birth_date,college_name\nG1,,Ann Lee,2000-01-01,Ohio St.\nG2,P2,Bob Ray,,\n")
    (n / "combine.csv").write_text("pfr_id,player_name,school,pos,draft_year,ht,wt,forty,bench,vertical,broad_jump,cone,shuttle\nP1,Ann Lee,Ohio State,QB,2020,6-2,220,4.6,,30,110,7,4.3\nP2,Bob Ray,,QB,2020,6-1,210,4.8,,,,,\n")
    (n / "draft_picks.csv").write_text("season,pick,pfr_player_id,pfr_player_name,college\n2020,1,P1,Ann Lee,Ohio St.\n")
    (n / "snap_counts_2020.csv").write_text("pfr_player_id,season,week\nP1,2020,1\nP9,2020,1\n")
    (tmp_path / "reference" / "team_code_mapping.csv").write_text("pfr_code,nflverse_code,team_name\ncrd,ARI,Arizona Cardinals\n")
    (tmp_path / "raw" / "executives" / "crd_executives.csv").write_text("Person,Teams,From,To,Titles,Notes\nAnn,ARI,2001,2004,GM,\n")
    return tmp_path


def test_process_runs_what_has_landed(spark, data):
    out = str(data / "out")
    assert process.process(spark, str(data), out, 2021) == {"depth_charts": "skipped", "tenures": "done", "identities": "done", "scores": "done"}
    assert spark.read.parquet(f"{out}/yas_complete").filter("calculation_type = 'current'").count() == 2
    snaps = {r.pfr_player_id: r.yamplayer_id for r in spark.read.parquet(f"{out}/snap_counts").collect()}
    assert snaps["P9"] is None and snaps["P1"].startswith("YAMP_")
    ids = {r.player_name: r.yamplayer_id for r in spark.read.parquet(f"{out}/combine").collect()}
    assert ids["Ann Lee"] == snaps["P1"] and len(set(ids.values())) == 2


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        process.identities(spark, str(tmp_path), str(tmp_path))


def test_command_line(spark, data, capsys):
    assert main(["groups"]) == 0 and main(["views", "--data", str(data)], spark) == 0 and main(["status", "--data", str(data)], spark) == 0
    assert main(["sql", "--data", str(data), "SELECT count(*) AS n FROM nflverse_combine"], spark) == 0
    said = capsys.readouterr().out
    assert "essential" in said and "nflverse_players" in said and "2" in said


def test_draft_session(spark):
    rows = [("q1", "QB", 400, 1, "S1"), ("r1", "RB", 300, 2, None), ("q2", "QB", 50, 3, None), ("r2", "RB", 150, 4, None), ("q3", "QB", 30, 5, None), ("r3", "RB", 100, 6, None), ("DST_ARI", "DEF", 10, 7, None)]
    pool = spark.createDataFrame([(i, i.upper(), p, "T", float(v), float(a), 2.0, s) for i, p, v, a, s in rows], "player_id string, name string, position string, team string, projected_points double, adp double, adp_std double, sleeper_id string")
    league = League(2, RosterConfig(qb=1, rb=1, wr=0, te=0, k=0, def_=0, flex=0, bench=1))
    s = DraftSession(spark, league, [Manager("a", "a", 1, True), Manager("b", "b", 2)], pool, candidates=3, simulations=40)
    first = s.prescored().collect()
    assert len(first) == 3 and first[0].player_id == "q1"
    best = s.recommendations().collect()
    assert best[0].player_id == "q1" and {"mean_score", "std_score", "vor", "risk"} <= set(best[0].asDict())
    s.process_pick("S1")
    assert s.state.current_pick == 2 and "q1" not in s.state.available
    s.process_pick("nobody", "LB", "")
    assert s.state.rosters["b"][0]["player_id"] == "unknown_nobody" and s.state.rosters["b"][0]["position"] == "QB"
    assert s.resolve("", "DEF", "ARI")["player_id"] == "DST_ARI" and s.resolve("", "K", "")["player_id"] == "unknown_K_UNK"
    s.cancel()
