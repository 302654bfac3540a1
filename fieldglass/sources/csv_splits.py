"""CSV whose fields may hold line breaks, read in splits.

Spark's text reader gives each task whole lines of a split, in order. One pass notes for every line its quotes' parity,
the parity before it within its split, and how many records began in the split so far, if the split begins outside a
field and if it begins inside one. What a split really begins in follows from the parities of the earlier splits of its
file: a few bytes a split, the only thing looked at in order. Lines that are a record by themselves go on where they
are; lines of a record that goes on in the next line, or in the next split, meet by a shuffle on the record.

Lines are written to the shared folder once, for splits may be cut otherwise in a second scan. A field is quoted whole
or not at all and quotes inside are doubled, as CSV writers do; a lone quote inside an unquoted field is not told from
an opening one. A file whose last quote never closes ends in one record. Files may have several columns of breaks, CR LF
ends, empty lines (no record), a byte order mark; an empty file has no records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.cluster import ship_package
from fieldglass.shared import written

LINES = "file string, start long, line long, text string, own boolean, before boolean, r0 long, r1 long"


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row for each line, written: its split (file, start), place in it, and what the module's head says."""
    raw = ship_package(spark).read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, n, began = None, False, 0, [0, 0]
        for batch in batches:
            own = np.array([t.count('"') % 2 == 1 for t in batch.column(2).to_pylist()], bool)
            place, before, r0, r1 = np.empty(len(own), np.int64), np.empty(len(own), bool), np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            for i, here in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if here != split:
                    split, inside, n, began = here, False, 0, [0, 0]
                began[inside] += 1  # a record begins here if the split began as the line does
                place[i], before[i], r0[i], r1[i] = n, inside, began[0], began[1]
                inside, n = inside ^ bool(own[i]), n + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), batch.column(2), pa.array(own), pa.array(before), pa.array(r0), pa.array(r1)], names=["file", "start", "line", "text", "own", "before", "r0", "r1"])

    return written(raw.mapInArrow(noted, LINES), "lines")


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, r, text): the text of each record, by the split it begins in and its place there, from 1."""
    every = lines(spark, path)
    splits = every.groupBy("file", "start").agg((F.sum(F.col("own").cast("int")) % 2 == 1).alias("odd"), F.max("r0").alias("n0"), F.max("r1").alias("n1"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    opened = F.last(F.when(F.col("n") > 0, F.struct(F.col("start").alias("s"), F.col("n").alias("r"))), ignorenulls=True).over(earlier)
    splits = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), "inside", opened.alias("opened"))
    placed = every.join(splits, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).drop("f", "s")
    placed = placed.withColumns({"in": F.col("before") != F.col("inside"), "r": F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))})
    alone = placed.filter(~F.col("in") & ~F.col("own")).select("file", "start", "r", "text")
    # lines before the split's first record belong to the last one of an earlier split
    owner = F.when(F.col("r") > 0, F.struct(F.col("start").alias("s"), F.col("r").alias("r"))).otherwise(F.col("opened"))
    shared = placed.filter(F.col("in") | F.col("own")).select("file", owner.alias("o"), F.struct("start", "line", "text").alias("l"))
    several = shared.groupBy("file", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("text"))
    return alone.unionByName(several.select("file", F.col("o.s").alias("start"), F.col("o.r").alias("r"), "text"))


def fields(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, r, values): the fields of each record; empty lines are none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [next(csv.reader(io.StringIO(t, newline="")), []) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.string()))], names=["file", "start", "r", "values"])

    return records(spark, path).mapInArrow(cut, "file string, start long, r long, values array<string>").filter(F.size("values") > 0)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Names in a file's first line, which has no break in a name."""
    first = spark.read.text(path, lineSep="\n").first()
    if first is None:
        raise ValueError(f"{path} has no header")
    return [n.removeprefix("\ufeff") for n in next(csv.reader([first[0]]), [])]


def read_csv_splits(spark: SparkSession, path: str, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of one file by its header's names, all texts, and (file, records, short): how many records there are besides the header, and
    how many have fewer than ``width`` fields, which are left out. Without ``width`` short records are filled with nulls."""
    every = written(fields(spark, path), "fields")
    first = every.filter("start = 0 AND r = 1").select("values").first()
    if first is None:
        raise ValueError(f"{path} has no header")
    names = [n.removeprefix("﻿") for n in first[0]]
    body = every.filter("NOT (start = 0 AND r = 1)")
    least = width or 0
    rows = body.filter(F.size("values") >= least).select(*[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows, body.groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.size("values") < least).alias("short"))
