"""Tables laid out for lookups by any of a few columns, in place of secondary indexes.

Each column's values are cut into ranges of about equally many distinct values; a row's range numbers are interleaved bit
by bit (Z-order), and files follow that order. So every file and row group holds a narrow range of each column, and a
lookup by any of them reads few: their least and largest values in the Parquet footers rule the others out. Bloom filters
on id columns rule out those whose range holds the value by chance.

Nulls are in the first range. Columns of any orderable type. An empty table gives an empty table of its schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of a column are 2^BITS.
BITS = 6


def cut_points(df: DataFrame, column: str, bits: int = BITS) -> list:
    """Where the ranges of a column begin, but for the first: 2^bits - 1 values at most."""
    ones = df.filter(F.col(column).isNotNull()).select(column).distinct()
    starts = ones.repartitionByRange(1 << bits, column).groupBy(F.spark_partition_id()).agg(F.min(column).alias("v"))
    return sorted(r.v for r in starts.collect())[1:]


def range_number(column: str, cuts: Sequence) -> Column:
    """How many cut points are at most the value."""
    found = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)
    return F.when(F.col(column).isNull(), 0).otherwise(found)


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """Bits of the numbers by turns, the highest first."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for n in numbers:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(n.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")))
    return out


def store_for_lookup(df: DataFrame, path: str, columns: Sequence[str], ids: Sequence[str] = (), files: int | None = None, row_group_bytes: int | None = None, distinct_ids: int = 1_000_000) -> DataFrame:
    """Write ``df`` in Z-order of ``columns``, with Bloom filters on ``ids``, and read it back."""
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = interleaved([range_number(c, cut_points(df, c)) for c in columns])
    ordered = df.withColumn("__z", z).repartitionByRange(files, "__z", *columns).sortWithinPartitions("__z", *columns).drop("__z")
    writer = ordered.write.mode("overwrite")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct_ids)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of ``df`` hand on when it runs: what row groups the footers and Bloom filters leave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size()))
