"""One draft followed to its end: picks in, ranked candidates out."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from fieldglass.plans import draft
from fieldglass.plans.league import POSITIONS, DraftState, League, Manager
from fieldglass.plans.simulate import PickModel, simulate_candidates, snapshot

PLAYER = "player_id string, name string, position string, team string, projected_points double, adp double, adp_std double"


def placeholder(raw_id: str, position: str, team: str) -> dict:
    """Stands for a picked player that the pool does not know; it scores nothing."""
    key = raw_id or f"{position}_{team or 'UNK'}"
    return {"player_id": f"unknown_{key}", "name": f"Unknown ({position or 'UNK'})", "position": position if position in POSITIONS else "QB", "team": team or "FA", "projected_points": 0.0, "adp": 999.0, "adp_std": 5.0}


class DraftSession:
    """State of a live draft on the driver, with the scoring plans over its available players.

    The pool is read once (a draft has some hundred players); every ranking is a Spark plan over what is left of it.
    """

    def __init__(self, spark: SparkSession, league: League, managers: Sequence[Manager], pool: DataFrame, candidates: int = 20, simulations: int = 500, others: PickModel = PickModel()):
        self.spark, self.candidates, self.simulations, self.others = spark, candidates, simulations, others
        columns = [c.split()[0] for c in PLAYER.split(", ")]
        rows = [r.asDict() for r in pool.select(*columns, *[c for c in ("sleeper_id",) if c in pool.columns]).collect()]
        self.index = {r.get("sleeper_id") or r["player_id"]: r for r in rows} | {r["player_id"]: r for r in rows}
        self.state = DraftState(league, tuple(managers), {r["player_id"]: r for r in rows})
        self.levels = {r["position"]: r["replacement"] for r in draft.levels(self.frame(), league).collect()}  # one number for each position, of the whole pool
        self.tag = f"recommend-{uuid.uuid4().hex}"

    def frame(self) -> DataFrame:
        rows = [tuple(p[c.split()[0]] for c in PLAYER.split(", ")) for p in self.state.available.values()]
        return self.spark.createDataFrame(rows, PLAYER)

    def resolve(self, player_id: str, position: str = "", team: str = "") -> dict:
        found = self.index.get(f"DST_{team}") if position in ("DEF", "DST") else self.index.get(player_id)
        return found or placeholder(player_id, position, team)

    def process_pick(self, player_id: str, position: str = "", team: str = "") -> DraftState:
        self.state = self.state.apply(self.resolve(player_id, position, team))
        return self.state

    def prescored(self) -> DataFrame:
        """Best candidates by score alone, to show at once."""
        me = next(m for m in self.state.managers if m.is_user)
        counts = Counter(p["position"] for p in self.state.rosters.get(me.manager_id, ()))
        levels = self.spark.createDataFrame(list(self.levels.items()), "position string, replacement double")
        scored = draft.draft_scores(self.frame(), self.state.league, self.state.picks_until_user(), counts, replacement=levels)
        return draft.best_candidates(scored, self.candidates)

    def recommendations(self, seed: int = 0) -> DataFrame:
        """The candidates after simulation, best mean first."""
        scored = self.prescored()
        ids = [r.player_id for r in scored.collect()]  # `candidates` rows
        if not ids:
            return scored.select("player_id").limit(0)
        self.spark.addTag(self.tag)
        try:
            simulated = simulate_candidates(self.spark, snapshot(self.state, self.levels, self.others), ids, self.simulations, seed=seed)
            return draft.recommendations(scored, simulated)
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> None:
        """Give up running simulations: a newer pick has overtaken them."""
        self.spark.interruptTag(self.tag)


