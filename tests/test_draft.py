import numpy as np
import pytest

from fieldglass.plans import draft, simulate
from fieldglass.plans.league import DraftState, League, Manager, RosterConfig, Scoring, snake_order, snake_slot, user_turns


def pool(spark, *players):
    return spark.createDataFrame([(i, n, p, float(v), float(a)) for i, (n, p, v, a) in enumerate([(x[0], x[1], x[2], x[3]) for x in players])], "k int, player_id string, position string, projected_points double, adp double").withColumn("name", __import__("pyspark.sql.functions", fromlist=["col"]).col("player_id"))


def levels(spark, players, teams, shares=None, **slots):
    base = dict(qb=0, rb=0, wr=0, te=0, k=0, def_=0, flex=0, bench=1) | slots
    return {r[0]: r[1] for r in draft.levels(pool(spark, *players), League(teams, RosterConfig(**base)), shares).collect()}


def test_replacement_levels(spark):
    qbs = [(f"q{i}", "QB", v, i) for i, v in enumerate((300, 250, 200, 150))]
    assert levels(spark, qbs, 2, qb=1)["QB"] == 200
    rbs = [(f"r{i}", "RB", v, i) for i, v in enumerate((200, 180, 160, 140, 120))]
    assert levels(spark, rbs, 2, rb=1, flex=1)["RB"] == 140
    assert levels(spark, rbs[:2], 2, rb=1)["RB"] == 0.0
    six = [(f"r{i}", "RB", v, i) for i, v in enumerate((240, 220, 200, 180, 160, 140))]
    assert levels(spark, six, 2, {"RB": 1.0}, rb=1, flex=1)["RB"] == 160


def test_vona_takes_the_earliest_and_never_oneself(spark):
    p = pool(spark, ("a", "QB", 300, 1), ("b", "QB", 250, 2), ("c", "QB", 200, 3), ("d", "RB", 90, 4))
    got = {r.player_id: r.vona for r in draft.value_over_next(p, 1).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": -50.0, "d": 90.0}


def test_needs():
    r = RosterConfig(qb=1, rb=2, wr=2, te=1, flex=1, k=1, def_=0)
    deep = draft.need_with_depth(r, {"QB": 1, "RB": 3, "K": 1})
    assert deep["QB"] == 0.5 and deep["RB"] == 0.0 and deep["K"] == 0.0 and deep["DEF"] == 0.0 and deep["WR"] == 1.0
    assert draft.need_of_slots(r, {"RB": 1})["RB"] == 0.5
    assert draft.need_with_floor(r, {"RB": 2})["RB"] == 0.15 and draft.need_with_floor(r, {})["DEF"] == 0.15


def test_lineup_uses_flex(spark):
    p = pool(spark, ("r1", "RB", 300, 1), ("r2", "RB", 250, 2), ("r3", "RB", 200, 3), ("q1", "QB", 280, 4), ("q2", "QB", 270, 5))
    roster = RosterConfig(qb=1, rb=2, wr=0, te=0, k=0, def_=0, flex=1, flex_eligible=("RB",))
    seats = {r.player_id: r.seat for r in draft.lineup(p, roster).collect()}
    assert seats == {"r1": "RB", "r2": "RB", "r3": "FLEX", "q1": "QB", "q2": "BENCH"}


def test_scores_are_ordered(spark):
    p = pool(spark, ("q1", "QB", 400, 1), ("r1", "RB", 300, 2), ("r2", "RB", 270, 3), ("q2", "QB", 50, 4))
    out = draft.draft_scores(p, League(2, RosterConfig(qb=1, rb=1, wr=1, te=0, k=0, def_=0, flex=0, bench=1)), 1).collect()
    assert [r.total_score for r in out] == sorted((r.total_score for r in out), reverse=True) and out[0].player_id == "q1"


def test_snake(spark):
    assert [snake_slot(p, 3) for p in range(1, 8)] == [1, 2, 3, 3, 2, 1, 1]
    got = snake_order(spark, 2, 4, 1).orderBy("pick").collect()
    assert [r.slot for r in got] == [1, 2, 2, 1, 1, 2, 2, 1]
    assert [r.until_user for r in got][:3] == [2, 1, 0]


def test_settings_are_validated():
    for bad in (lambda: League(1), lambda: Manager("a", "a", 0), lambda: Scoring(passing_yards_per_point=0), lambda: RosterConfig(qb=-1), lambda: DraftState(League(2), (Manager("a", "a", 1, True),))):
        with pytest.raises(ValueError):
            bad()
    assert RosterConfig().rounds == 16 and Scoring.of("half_ppr").reception == 0.5


SIX = [("q1", "QB", 400, 1), ("r1", "RB", 300, 2), ("r2", "RB", 270, 3), ("q2", "QB", 50, 4), ("r3", "RB", 200, 5), ("r4", "RB", 150, 6)]


def state():
    players = {n: {"player_id": n, "position": p, "projected_points": float(v), "adp": float(a), "adp_std": 2.0} for n, p, v, a in SIX}
    return DraftState(League(2, RosterConfig(qb=1, rb=1, wr=0, te=0, k=0, def_=0, flex=0, bench=1)), (Manager("user", "u", 1, True), Manager("opp", "o", 2)), players)


def test_state_is_immutable():
    s = state()
    t = s.apply(s.available["q1"])
    assert s.current_pick == 1 and t.current_pick == 2 and "q1" not in t.available and t.rosters["user"][0]["player_id"] == "q1"
    assert s.picks_until_user() == 0 and t.picks_until_user() == 2  # the user's own turn; then the other manager's two at the turn
    for _ in range(5):
        t = t.apply(next(iter(t.available.values())))
    assert t.is_complete
    with pytest.raises(ValueError):
        t.apply({"player_id": "x"})


def test_picks_until_the_user_is_on_the_clock(spark):
    managers = tuple(Manager(f"m{i}", f"m{i}", i, i == 3) for i in range(1, 13))
    at = {p: DraftState(League(12), managers, picks=tuple((k, "", "") for k in range(1, p))).picks_until_user() for p in range(1, 61)}
    assert (at[3], at[1], at[13]) == (0, 2, 9)  # the own turn, two before it, and the first pick of a round that runs backwards
    assert {r.pick: r.picks_until_user for r in user_turns(spark, 12, 5, 3).collect()} == at


def test_snapshot_gaps():
    snap = simulate.snapshot(state(), {"QB": 50.0, "RB": 100.0})
    assert list(snap.owners) == [0, 1, 1, 0, 0, 1]
    assert [snap.until_user(i) for i in range(4)] == [2, 1, 0, 0]


def test_scarce_position_first(spark):
    snap = simulate.snapshot(state(), {"QB": 50.0, "RB": 150.0})
    got = simulate.simulate_candidates(spark, snap, ["q1", "r1", "q2"], 200, 50, seed=1).collect()
    mean = {r.player_id: r.mean_score for r in got}
    assert got[0].player_id == "q1" and mean["q1"] > mean["r1"] > mean["q2"] and all(r.n_simulations == 200 for r in got)


def test_adp_picks_follow_adp():
    snap = simulate.snapshot(state(), {})
    rng = np.random.default_rng(0)
    available, counts = np.repeat(snap.available[None], 1000, 0), np.zeros((1000, 6), int)
    picks = simulate.choose(snap, 0, available, counts, simulate.PickModel(simulate.ADP), rng)
    share = np.bincount(picks, minlength=6) / 1000
    assert share[0] > share[2] > share[5]
    full = np.zeros((1000, 6), int)
    full[:, 0] = 1
    less = simulate.choose(snap, 0, available, full, simulate.PickModel(simulate.NEED_ADP, need_weight=1.0, floor=0.0, fade=0.0), rng)
    assert (less == 0).sum() == 0
    greedy = simulate.choose(snap, 0, available, full, simulate.PickModel(simulate.GREEDY_VOR), rng)
    assert set(greedy) == {1}


def test_lineup_score_equals_the_relational_one(spark):
    snap = simulate.snapshot(state(), {})
    mine = np.array([[True, True, True, False, False, False], [False, False, False, True, True, True]])
    assert simulate.lineup_score(snap, mine).tolist() == [700.0, 250.0]


def test_weighted_models_agree_with_scarcity_plan(spark):
    snap = simulate.snapshot(state(), {})
    got = dict(zip(snap.ids, simulate.scarcity(snap, snap.available[None])[0]))
    want = {r.player_id: r.scarcity for r in draft.gradient_scarcity(pool(spark, *SIX)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_a_pick_model_of_ones_own(spark):
    worst = simulate.PickModel(lambda s, at, available, counts, rng: np.where(available, s.points, np.inf).argmin(axis=1))
    snap = simulate.snapshot(state(), {}, worst, worst)
    got = {r.player_id: (r.mean_score, r.std_score) for r in simulate.simulate_candidates(spark, snap, ["q1", "r1"], 4, 2).collect()}
    assert got == {"q1": (670.0, 0.0), "r1": (300.0, 0.0)}  # q1 and r2; r1 alone, without a quarterback
    gone = simulate.PickModel(lambda s, at, available, counts, rng: np.zeros(len(available), int))
    with pytest.raises(ValueError):
        simulate.simulate(simulate.snapshot(state(), {}, gone, gone), "q1", 2, np.random.default_rng(0))
