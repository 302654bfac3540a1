"""League and draft settings: small records kept on the driver and turned into columns where needed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import next_true_distance

POSITIONS = ("QB", "RB", "WR", "TE", "K", "DEF")
SCORING = ("ppr", "half_ppr", "standard")


@dataclass(frozen=True)
class Scoring:
    """Points for each kind of play; yards are counted per point. The defaults."""

    passing_yards_per_point: float = 25.0
    passing_td: float = 4.0
    passing_int: float = -2.0
    rushing_yards_per_point: float = 10.0
    rushing_td: float = 6.0
    receiving_yards_per_point: float = 10.0
    receiving_td: float = 6.0
    reception: float = 1.0
    fumble_lost: float = -2.0

    def __post_init__(self):
        if min(self.passing_yards_per_point, self.rushing_yards_per_point, self.receiving_yards_per_point) <= 0:
            raise ValueError("yards per point must be positive")

    @classmethod
    def of(cls, kind: str) -> Scoring:
        if kind not in SCORING:
            raise ValueError(f"unknown scoring {kind!r}")
        return cls(reception={"ppr": 1.0, "half_ppr": 0.5, "standard": 0.0}[kind])


@dataclass(frozen=True)
class RosterConfig:
    """Places of a roster. The defaults."""

    qb: int = 1
    rb: int = 2
    wr: int = 3
    te: int = 1
    flex: int = 1
    k: int = 1
    def_: int = 1
    bench: int = 6
    ir_slots: int = 0
    flex_eligible: tuple[str, ...] = ("RB", "WR", "TE")

    def __post_init__(self):
        if min(self.qb, self.rb, self.wr, self.te, self.flex, self.k, self.def_, self.bench, self.ir_slots) < 0:
            raise ValueError("slots can't be negative")

    @property
    def slots(self) -> dict[str, int]:
        return dict(zip(POSITIONS, (self.qb, self.rb, self.wr, self.te, self.k, self.def_)))

    @property
    def starters(self) -> int:
        return sum(self.slots.values()) + self.flex

    @property
    def rounds(self) -> int:
        return self.starters + self.bench

    @property
    def capacity(self) -> int:
        return self.rounds + self.ir_slots


@dataclass(frozen=True)
class Manager:
    manager_id: str
    name: str
    draft_slot: int
    is_user: bool = False

    def __post_init__(self):
        if self.draft_slot < 1:
            raise ValueError("draft slots count from 1")


@dataclass(frozen=True)
class League:
    team_count: int = 12
    roster: RosterConfig = field(default_factory=RosterConfig)
    scoring: Scoring = field(default_factory=Scoring)

    def __post_init__(self):
        if self.team_count < 2:
            raise ValueError("a league has two teams at least")
        if self.roster.rounds < 1:
            raise ValueError("a roster has a place at least")

    @property
    def total_picks(self) -> int:
        return self.team_count * self.roster.rounds


def snake_slot(pick: int, teams: int) -> int:
    """Draft slot whose turn pick 1, 2, ... is."""
    round_, place = divmod(pick - 1, teams)
    return teams - place if round_ % 2 else place + 1


@dataclass(frozen=True)
class DraftState:
    """Immutable state of a draft: a pick gives a new state."""

    league: League
    managers: tuple[Manager, ...]
    available: dict = field(default_factory=dict)
    rosters: dict = field(default_factory=dict)
    picks: tuple = ()

    def __post_init__(self):
        if len(self.managers) != self.league.team_count:
            raise ValueError("one manager for each team")
        if sum(m.is_user for m in self.managers) != 1:
            raise ValueError("exactly one manager is the user")

    @property
    def current_pick(self) -> int:
        return len(self.picks) + 1

    @property
    def is_complete(self) -> bool:
        return self.current_pick > self.league.total_picks

    @property
    def current_round(self) -> int:
        return (self.current_pick - 1) // self.league.team_count + 1

    def on_the_clock(self, pick: int | None = None) -> Manager:
        slot = snake_slot(pick or self.current_pick, self.league.team_count)
        return next(m for m in self.managers if m.draft_slot == slot)

    def picks_until_user(self) -> int:
        """Picks by others before the user is on the clock: 0 on the user's own turn, a whole round's where none is left."""
        ahead = range(self.current_pick, self.current_pick + self.league.team_count)
        return next((p - self.current_pick for p in ahead if self.on_the_clock(p).is_user), self.league.team_count)

    def apply(self, player: dict) -> DraftState:
        if self.is_complete:
            raise ValueError("the draft is complete")
        who = self.on_the_clock().manager_id
        left = {k: v for k, v in self.available.items() if k != player["player_id"]}
        rosters = {**self.rosters, who: (*self.rosters.get(who, ()), player)}
        return replace(self, available=left, rosters=rosters, picks=(*self.picks, (self.current_pick, who, player["player_id"])))


def snake_order(spark: SparkSession, teams: int, rounds: int, user_slot: int | None = None) -> DataFrame:
    """pick, round, in_round, slot for all picks; with a user's slot also is_user and the picks between this one and the user's next."""
    p = F.col("pick") - 1
    df = spark.range(1, teams * rounds + 1).withColumnRenamed("id", "pick")
    df = df.withColumns({"round": F.floor(p / teams) + 1, "in_round": p % teams + 1})
    df = df.withColumn("slot", F.when(F.col("round") % 2 == 1, F.col("in_round")).otherwise(teams - F.col("in_round") + 1))
    if user_slot is None:
        return df
    df = df.withColumns({"is_user": F.col("slot") == user_slot, "at": p})
    return df.withColumn("until_user", next_true_distance("is_user", "at", [F.lit(0)])).drop("at")


def user_turns(spark: SparkSession, teams: int, rounds: int, user_slot: int) -> DataFrame:
    """pick, picks_until_user: the picks before the user is on the clock, 0 on the user's own turn, a whole round's at most.

    In closed form: the order turns at each round's end, so the user's place is this round's, or its mirror image in the next.
    """
    order = snake_order(spark, teams, rounds)
    turn = F.when(F.col("round") % 2 == 1, F.lit(user_slot)).otherwise(F.lit(teams + 1 - user_slot))
    here = turn - F.col("in_round")
    ahead = F.when(here >= 0, here).otherwise(teams - F.col("in_round") + (teams + 1 - turn))
    return order.select("pick", F.least(ahead, F.lit(teams)).cast("bigint").alias("picks_until_user"))
