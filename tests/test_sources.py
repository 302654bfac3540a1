import pytest
from pyspark.sql import functions as F

from fieldglass.sources import catalog, documents, registry


@pytest.fixture
def data(tmp_path):
    (tmp_path / "nflverse").mkdir()
    (tmp_path / "raw-x y").mkdir()
    (tmp_path / "nflverse" / "combine.csv").write_text('pfr_id,season,ht\nP1,2020,"6-2"\nP2,2021\n')
    (tmp_path / "nflverse" / "snap_counts_2020.csv").write_text("pfr_player_id,season,week\nP1,2020,1\n")
    (tmp_path / "nflverse" / "snap_counts_2021.csv").write_text("pfr_player_id,season,week,extra\nP1,2021,1,z\n")
    (tmp_path / "raw-x y" / "a-b.csv").write_text('k,t\n1,"line\nbreak"\n')
    return str(tmp_path)


def test_views_follow_the_folders(spark, data):
    spark.range(3).write.parquet(f"{data}/nflverse/p.parquet")
    found = catalog.register_views(spark, data)
    assert {"nflverse_combine", "raw_x_y_a_b"} <= set(found)
    assert spark.sql("SELECT t FROM raw_x_y_a_b").first()[0] == "line\nbreak"
    with pytest.raises(FileNotFoundError):
        catalog.register_views(spark, data + "/nothing")


def test_tables_are_stored_with_rows_and_layout(spark, data):
    got = catalog.create_tables(spark, data)
    assert got == {"nflverse.combine": 2, "nflverse.snap_counts": 2}
    t = spark.table("nflverse.snap_counts")
    assert "extra" in t.columns and catalog.has_table(spark, "nflverse.combine") and not catalog.has_table(spark, "nflverse.nothing")
    assert "PartitionFilters: [isnotnull(season" in t.filter("season = 2020")._jdf.queryExecution().executedPlan().toString()
    assert set(catalog.catalog_tables(spark)) == {"combine", "snap_counts"}
    assert catalog.run_sql(spark, "SELECT count(*) AS n FROM nflverse.combine WHERE ht IS NULL;").first().n == 1


def test_cached_scan_and_csv(spark, data, tmp_path):
    scan = catalog.CachedScan(spark, f"{data}/nflverse/combine.csv")
    assert scan.get() is scan.get() and scan.get(refresh=True).count() == 2
    with pytest.raises(ValueError):
        catalog.CachedScan(spark, None)
    catalog.write_csv(scan.get(), str(tmp_path / "out"))
    assert catalog.read_csv(spark, str(tmp_path / "out"), infer=False).dtypes[1] == ("season", "string")


def test_registry_groups():
    assert len(registry.ALL) == 23 and registry.select("all", without=registry.LARGE) == registry.ANALYSIS and registry.ESSENTIAL < registry.ANALYSIS
    assert registry.describe("x") == "unknown group"


def test_side_by_side_keeps_errors():
    seen = []
    out = {o.name: o for o in registry.side_by_side({"a": lambda: 1, "b": lambda: 1 / 0}, done=seen.append)}
    assert out["a"].result == 1 and "ZeroDivisionError" in out["b"].error and len(seen) == 2


def test_landing(spark, tmp_path):
    paths = registry.land(spark, lambda name, season: spark.range(2), "snap_counts", str(tmp_path), [2021, 2020])
    assert [p[-4:] for p in paths] == ["2020", "2021"]
    with pytest.raises(KeyError):
        registry.land(spark, None, "nothing", str(tmp_path))


def test_manifest_merges(tmp_path):
    m = registry.Manifest(str(tmp_path / "m" / "manifest.json"), lambda: "2026-01-01")
    m.write({"datasets": {"a": {"coverage": {"from": 1}}, "gm_executives": {}}, "transformation_scripts": {"s": {}}})
    m.verify("a", to=2)
    m.executives(32)
    m.script("s", {"rows": 1})
    assert m.info("a")["coverage"] == {"from": 1, "verified": True, "to": 2} and m.unverified() == [] and m.info("gm_executives")["files"] == 32
    assert m.names() == ["a", "gm_executives"] and m.read()["metadata"]["last_updated"] == "2026-01-01"
    with pytest.raises(KeyError):
        m.update("b", {})


def test_status(data):
    assert ("nflverse", 3) in [r[:2] for r in registry.status(data)]


def test_json_documents(spark):
    picks = spark.createDataFrame([('{"pick_no": 1, "round": 1, "draft_slot": 2, "picked_by": "u1", "player_id": "9", "metadata": {"position": "QB"}}', "d"), ("{}", "d")], "value string, draft_id string")
    got = documents.parse(picks, "pick")
    assert [r.player_id for r in got.collect()] == ["9", None]
    assert documents.order_of_first_round(got).first().draft_order == {"u1": 2}
    league = spark.createDataFrame([('{"league_id": "L", "scoring_settings": {"rec": 0.5}}',)], "value string")
    row = documents.parse_league(league).first()
    assert row.scoring_type == "half_ppr" and row.roster_positions == []
    draft = spark.createDataFrame([('{"draft_id": "D", "settings": {"slots_qb": 2}, "draft_order": {"u": 1}}',)], "value string")
    assert documents.parse_draft(draft).first().roster.qb == 2


PAGE = """<table><tr><td>menu</td></tr></table><table><tr><th></th><th>MISC</th></tr><tr><th>Player</th><th>FPTS</th></tr>
<tr><td><a href="x">Josh Allen</a> BUF</td><td>1,380.5</td></tr><tr><td>Bad Row X</td><td>-</td></tr><tr><td>short</td></tr></table>"""


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "QB", PAGE), (2, "QB", "<p>none</p>"), (3, "QB", None), (4, "DEF", PAGE.replace("Josh Allen</a> BUF", "Bills</a>"))], "page_id int, position string, html string")
    codes = spark.createDataFrame([("Buffalo Bills", "BUF")], "team_name string, nflverse_code string")
    got = sorted(tuple(r) for r in documents.projections(pages, codes).collect())
    assert got == [("Bills", "BUF", "DEF", 1380.5), ("Josh Allen", "BUF", "QB", 1380.5)]
    assert documents.html_tables(pages, ("Player", "FPTS")).filter("page_id = 1").count() == 2


def test_pages_are_dealt_out_and_parsed_once(spark):
    pages = spark.createDataFrame([(i // 2, "QB", PAGE) for i in range(400)], "page_id int, position string, html string").coalesce(1)
    assert documents.html_tables(pages, ("Player", "FPTS")).select(F.spark_partition_id()).distinct().count() > 8
    codes = spark.createDataFrame([("Buffalo Bills", "BUF")], "team_name string, nflverse_code string")
    got = documents.projections(pages, codes)
    assert got.count() == 400  # two pages of one id are two
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "NOT (position" in plan.split("MapInArrow")[1]  # below the parser, not above it


def test_service_documents_by_name(spark):
    from fieldglass.sources.service import PATHS, DraftService

    answers = {
        "http://s/v1/draft/7": {"draft_id": "7", "status": "complete", "settings": {"rounds": 15}},
        "http://s/v1/draft/7/picks": [{"pick_no": 1, "player_id": "a"}, {"pick_no": 2, "player_id": "b"}],
        "http://s/v1/league/9": {"league_id": "9", "scoring_settings": {"rec": 0.5}},
        "http://s/v1/league/9/rosters": [{"roster_id": 1, "players": ["a"]}, {"roster_id": 2}],
        "http://s/v1/players/nfl/trending/add?lookback_hours=24&limit=5": [{"player_id": "a", "count": 3}],
        "http://s/v1/user/a%2Fb": None,
    }
    service = DraftService(spark, "http://s/v1/", answers.__getitem__)
    assert [r.player_id for r in service.get("picks", draft_id="7").collect()] == ["a", "b"]
    assert service.scoring_type("9") == "half_ppr" and service.get("draft", draft_id=7).first().roster.bench == 6
    assert [r.players for r in service.get("league_rosters", league_id=9).collect()] == [["a"], []]
    assert service.get("trending", limit=5).first().asDict() == {"player_id": "a", "count": 3}
    assert service.get("user", username="a/b").count() == 0
    assert service.is_complete("7", 2) and not service.is_complete("7", 1)
    with pytest.raises(KeyError):
        service.url("matchups", league_id=9)
    assert len(PATHS) == 11
