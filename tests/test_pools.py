"""Drafts over pools that stay in Spark, against the same drafts in memory."""

import numpy as np
import pytest

from fieldglass.plans import simulate
from fieldglass.plans.league import DraftState, League, Manager, RosterConfig


@pytest.fixture(scope="module")
def drafted(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.gamma(2.0, 40.0, 400), 1)
    points[rng.integers(0, 400, 60)] = 33.3  # many that are equal
    rows = [(f"p{i}", ["QB", "RB", "WR", "TE"][rng.integers(0, 4)], float(points[i]), float(i + 1), 2.0) for i in range(400)]
    players = spark.createDataFrame(rows, "player_id string, position string, projected_points double, adp double, adp_std double")
    state = DraftState(League(2, RosterConfig(qb=1, rb=1, wr=1, te=0, k=0, def_=0, flex=1, bench=1)), (Manager("u", "u", 1, True), Manager("o", "o", 2)))

    def both(*models):
        out = []
        with pytest.MonkeyPatch.context() as patch:
            for most in (10**6, 0):
                patch.setattr(simulate, "IN_MEMORY", most)
                out.append(simulate.pool_snapshot(spark, state, players, {"QB": 50.0, "RB": 20.0}, *models)[0])
        return out

    return both


@pytest.mark.parametrize("seed", range(5))
def test_a_part_of_a_pool_scores_as_the_whole(drafted, seed):
    whole, pool = drafted()
    assert isinstance(pool, simulate.Pool) and len(pool.ids) == len(whole.ids) == 400
    rng = np.random.default_rng(seed)
    asked = rng.integers(0, 400, (1, 1, 12))
    core = np.union1d(pool.matter(["p3"]), asked)
    all_rows = pool.players.select(*simulate.COLUMNS).toPandas()
    rows = all_rows[all_rows.number.isin((core[:, None] + np.arange(-2, 3)).ravel())]
    part = pool.part(rows, core, {4: asked[0]})
    assert len(part.ids) < 400 and [part.ids[i] for i in part.offers[4][0]] == list(all_rows.set_index("number").player_id[asked[0, 0]])
    gone = rng.choice(list(all_rows[all_rows.number.isin(core)].player_id), 8, replace=False)
    counts = rng.integers(0, 2, (1, 6))
    scores = []
    for s in (whole, part):
        available = (s.available & ~np.isin(s.ids, gone))[None]
        scores.append(dict(zip(s.ids, simulate.composite(s, available, counts, 3, simulate.PickModel(simulate.WEIGHTED))[0])))
    exact = [i for i, e in zip(part.ids, part.exact) if e and i not in gone]
    assert len(exact) > 100 and np.allclose([scores[0][i] for i in exact], [scores[1][i] for i in exact], rtol=0, atol=1e-12)


def test_drafts_over_a_pool_in_spark_equal_those_in_memory(spark, drafted):
    greedy = simulate.PickModel(simulate.GREEDY_VOR)
    a, b = (simulate.simulate_candidates(spark, s, ["p0", "p7", "p300"], 4, 2).collect() for s in drafted(greedy, greedy))
    assert a == b and all(r.std_score == 0 for r in a)
    near = simulate.PickModel(simulate.NEED_ADP)
    a, b = ({r.player_id: r for r in simulate.simulate_candidates(spark, s, ["p0", "p7", "p300"], 1500, 500).collect()} for s in drafted(near, simulate.PickModel(simulate.WEIGHTED, temperature=0.4)))
    for k in a:
        assert b[k].n_simulations == 1500 and abs(a[k].mean_score - b[k].mean_score) < 5 * (a[k].std_score + b[k].std_score) / 2 * (2 / 1500) ** 0.5
        assert abs(a[k].std_score / b[k].std_score - 1) < 0.12


def test_offers_that_run_out_are_made_again(spark, drafted, monkeypatch):
    monkeypatch.setattr(simulate, "OFFERED", 1)
    got = simulate.simulate_candidates(spark, drafted()[1], ["p0"], 20, 10).collect()
    assert got[0].n_simulations == 20 and np.isfinite(got[0].mean_score)


def test_a_query_over_a_large_pool_sends_no_pool_to_the_tasks(spark, monkeypatch):
    from oracle import check

    from fieldglass.queries import ORACLE, QUERIES

    whole, sent = simulate.cloudpickle.dumps, []
    monkeypatch.setattr(simulate, "IN_MEMORY", 0)
    monkeypatch.setattr(simulate.cloudpickle, "dumps", lambda x, *how: sent.append(x) or whole(x, *how))
    check(spark, QUERIES["draft_deterministic"], ORACLE["draft_deterministic"], "/root/testdata/sf0.01")
    (_, rows, _), = [x for x in sent if isinstance(x, tuple) and len(x) == 3 and isinstance(x[0], simulate.Pool)]
    assert len(rows) < 300 < spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count()
