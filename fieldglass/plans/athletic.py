"""Athletic scores: percentiles of measurements within a position and year, and their percentile-ranked mean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import height_inches, percentile_rank, position_standard, row_count_present, row_mean
from fieldglass.operators import spread

#: Calculation groups and the positions in them.
GROUPS = {
    "QB": ["QB"], "RB": ["RB"], "FB": ["FB"], "OT": ["OT", "LT", "RT", "T"], "OG": ["OG", "LG", "RG", "G"], "C": ["C"],
    "OL": ["OT", "LT", "RT", "OG", "LG", "RG", "C"], "TE": ["TE"], "WR": ["WR", "CB/WR"], "CB": ["CB", "CB/WR"], "S": ["S", "SAF"],
    "DB": ["CB", "CB/WR", "S", "SAF"], "LB": ["LB", "ILB"], "EDGE": ["EDGE", "OLB"], "DT": ["DT"], "DE": ["DE"], "DL": ["DL", "DT", "DE"],
    "K": ["K"], "P": ["P"], "LS": ["LS"],
}
#: Measurements, and whether more is better.
MEASURES = {"bench": True, "broad_jump": True, "cone": False, "forty": False, "ht": True, "shuttle": False, "vertical": True, "wt": True}


def composite(df: DataFrame, by: Sequence[str], measures: Mapping[str, bool], score: str = "score", raw: str = "score_raw", present: str = "measures_present") -> DataFrame:
    """Percentile of each measure within ``by``, their mean over those present, and the percentile of that mean.

    All windows share the partitioning by ``by``: one shuffle, then a sort for each measure.
    """
    ranked = df.withColumns({f"{m}_percentile": percentile_rank(m, by, up) for m, up in measures.items()})
    each = [f"{m}_percentile" for m in measures]
    ranked = ranked.withColumns({raw: row_mean(each), present: row_count_present(each)})
    return ranked.withColumn(score, percentile_rank(raw, by))


def percentiles_by_value(df: DataFrame, value: str, by: Sequence[str], name: str, higher_is_better: bool = True, scale: float = 10.0) -> DataFrame:
    """The same percentile for groups too large for one task: ranks are taken over counts of distinct values, then joined back."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(value).asc() if higher_is_better else F.col(value).desc()
    window = Window.partitionBy(*by)
    below = F.coalesce(F.sum("__n").over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*by, value, ((below + (F.col("__n") + 1) / 2) / F.sum("__n").over(window) * scale).alias(name))
    return df.join(ranks, [*by, value], "left")


def athletic_scores(combine: DataFrame, current_year: int, first_year: int = 2000, parse_height: bool = False, expanding: bool = False) -> DataFrame:
    """A row for each player, calculation group, year and type.

    ``historical`` rows compare a draft year with itself (with ``expanding``, with all years up to it); ``current`` rows all years up to now.
    Heights are ranked as the texts they are unless ``parse_height``. Year by year copies are exploded in one pass, not looped.
    """
    year = F.col("draft_year").try_cast("int")
    kinds = F.struct(F.lit("current").alias("calculation_type"), F.lit(current_year).alias("calculation_year"))
    if expanding:
        years = F.sequence(F.greatest(year, F.lit(first_year)), F.lit(current_year))
        copies: Column = F.when(year <= current_year, F.concat(F.transform(years, lambda y: F.struct(F.lit("historical").alias("calculation_type"), y.alias("calculation_year"))), F.array(kinds)))
    else:
        own = F.struct(F.lit("historical").alias("calculation_type"), year.alias("calculation_year"))
        copies = F.when(year.between(first_year, current_year), F.array(own, kinds)).when(year < first_year, F.array(kinds))
    rows = combine.withColumn("__c", F.explode(copies)).select(*combine.columns, "__c.*")
    rows = spread(rows, "pos", GROUPS, "calculation_position").withColumn("yas_position", position_standard("pos"))
    if parse_height:
        rows = rows.withColumn("ht", height_inches("ht"))
    by = ["calculation_type", "calculation_year", "calculation_position"]
    return composite(rows, by, MEASURES, "yas_score", "yas_score_unnormallized", "measurables_present")


def score_leaders(scores: DataFrame, least: int = 5) -> DataFrame:
    """Current scores of players at their own position with enough measurements, best first."""
    mine = (F.col("calculation_position") == F.col("yas_position")) & (F.col("calculation_type") == "current") & (F.col("measurables_present") >= least)
    return scores.filter(mine).orderBy(F.col("yas_score").desc_nulls_last())
