"""Joins that plain equality does not say: disjunctions, tiers, fallbacks, unique names. All become equi joins.

Lookup sides are not forced into memory: Spark broadcasts a side when its statistics are under the session's
threshold and shuffles otherwise. Where a match could multiply rows, the right side is reduced to one row for each key.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import keep_first, literal_map

Tier = Sequence[tuple[Column, Column]]


def _named(df: DataFrame, columns: Sequence[Column], stem: str) -> tuple[DataFrame, list[str]]:
    names = [f"__{stem}{i}" for i in range(len(columns))]
    return df.withColumns(dict(zip(names, columns))), names


def anti_any(left: DataFrame, right: DataFrame, *tiers: Tier) -> DataFrame:
    """Rows of ``left`` without a partner by any of the tiers. "No match by A or B" is an anti join by A, then one by B."""
    for k, tier in enumerate(tiers):
        keyed, mine = _named(left, [a for a, _ in tier], f"a{k}_")
        other, theirs = _named(right, [b for _, b in tier], f"b{k}_")
        other = other.select(*theirs).dropna().distinct()
        on = functools.reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(mine, theirs)])
        left = keyed.join(other, on, "left_anti").drop(*mine)
    return left


def tiered_match(left: DataFrame, right: DataFrame, take: Sequence[str], tiers: Sequence[Tier], *ties: Column) -> DataFrame:
    """``left``, one row for each of its rows, with the columns ``take`` of the best partner: the first tier that has one, then by ``ties`` over ``right``.

    Each tier is an equi join against one row of ``right`` for each key, so no tier multiplies rows and no row needs an id.
    """
    hits = []
    for k, tier in enumerate(tiers):
        keys = [b.alias(f"__k{k}_{i}") for i, (_, b) in enumerate(tier)]
        side = right.select(*keys, F.struct(*take).alias(f"__m{k}"), *[t.alias(f"__t{i}") for i, t in enumerate(ties)])
        names = [f"__k{k}_{i}" for i in range(len(tier))]
        order = [F.col(f"__t{i}").asc_nulls_last() for i in range(len(ties))] or [F.col(f"__m{k}")]
        best = keep_first(side.dropna(subset=names), names, *order).select(*names, f"__m{k}")
        on = functools.reduce(Column.__and__, [a == F.col(n) for (a, _), n in zip(tier, names)])
        left = left.join(best, on, "left").drop(*names)
        hits.append(F.col(f"__m{k}"))
    chosen = F.coalesce(*hits)
    return left.withColumns({c: chosen[c] for c in take}).drop(*[f"__m{k}" for k in range(len(tiers))])


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key stands once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def lookup_id_then_unique(left: DataFrame, right: DataFrame, take: str, by_id: tuple[Column, Column], by_name: tuple[Column, Column], into: str | None = None) -> DataFrame:
    """Value ``take`` by id (of repeated ids the largest), else by name where the name is unique in ``right``."""
    into = into or take
    ids = right.select(by_id[1].alias("__id"), F.col(take).alias("__by_id")).dropna(subset=["__id"]).groupBy("__id").agg(F.max("__by_id").alias("__by_id"))
    names = right.select(by_name[1].alias("__name"), F.col(take).alias("__by_name")).dropna(subset=["__name"])
    names = names.groupBy("__name").agg(F.count("*").alias("__n"), F.max("__by_name").alias("__by_name")).filter("__n = 1").drop("__n")
    out = left.join(ids, by_id[0] == F.col("__id"), "left").join(names, by_name[0] == F.col("__name"), "left")
    return out.withColumn(into, F.coalesce("__by_id", "__by_name")).drop("__id", "__by_id", "__name", "__by_name")


def lookup_keys(left: DataFrame, right: DataFrame, take: str, *keys: tuple[Column, Column], into: str | None = None) -> DataFrame:
    """Value ``take`` by the first of several keys that finds one (of repeated keys the largest value)."""
    found = []
    for i, (mine, theirs) in enumerate(keys):
        side = right.select(theirs.alias(f"__k{i}"), F.col(take).alias(f"__v{i}")).dropna(subset=[f"__k{i}"]).groupBy(f"__k{i}").agg(F.max(f"__v{i}").alias(f"__v{i}"))
        left = left.join(side, mine == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(f"__v{i}")
    return left.withColumn(into or take, F.coalesce(*found)).drop(*found)


def fallback_join(left: DataFrame, first: DataFrame, first_on: Column, second: DataFrame, second_on: Column, missed: str) -> DataFrame:
    """Left join to ``first``; only rows for which its column ``missed`` stays null look into ``second``. Partners that repeat, repeat rows."""
    joined = left.join(first, first_on, "left")
    return joined.join(second, F.col(missed).isNull() & second_on, "left")


def enrich(base: DataFrame, source: DataFrame, fill: Mapping[str, Column], tiers: Sequence[Tier], *ties: Column) -> DataFrame:
    """Fills nulls of ``base`` columns from its best partner in ``source``: an UPDATE ... FROM with COALESCE, made deterministic."""
    names = {c: f"__f{i}_{uuid.uuid4().hex[:6]}" for i, c in enumerate(fill)}
    side = source.withColumns({names[c]: v for c, v in fill.items()})
    out = tiered_match(base, side, list(names.values()), tiers, *ties)
    return out.withColumns({c: F.coalesce(c, names[c]) for c in fill}).drop(*names.values())


def insert_missing(base: DataFrame, rows: DataFrame, *tiers: Tier) -> DataFrame:
    """``base`` and the distinct ``rows`` that match none of it; ``tiers`` pair columns of ``rows`` with those of ``base``."""
    return base.unionByName(anti_any(rows, base, *tiers).distinct(), allowMissingColumns=True)


def full_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of frames that share ``keys``, one after another."""
    return functools.reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def spread(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], into: str) -> DataFrame:
    """One row for each group that holds the value; values in no group vanish. The groups are a literal, so rows spread without a join."""
    member: dict[str, list[str]] = {}
    for name, values in groups.items():
        for v in values:
            member.setdefault(v, []).append(name)
    return df.withColumn(into, F.explode(F.try_element_at(literal_map(member), F.col(column))))


def missing_pairs(left: DataFrame, right: DataFrame, present: DataFrame) -> DataFrame:
    """All pairs of two small distinct sides (teams and weeks of a season) without those in ``present``."""
    return left.crossJoin(right).join(present, [*left.columns, *right.columns], "left_anti")
