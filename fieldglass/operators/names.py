"""Lookups of names in texts, and of texts in names, without comparing every pair.

``names_in`` finds which names occur in each text: the names, in blocks of a stated size, become an Aho-Corasick
automaton that every worker builds once, and texts go through it in Arrow batches. ``contained_in`` is the other way
round, for few names: all their substrings are a table, and each text is looked up in it by an equal key.

Null names and texts match nothing; an empty name is in every text. Names that repeat are one, the first in order.
Matching is by characters, case included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.cluster import ship_package
from fieldglass.shared import written

#: Names of an automaton, and their characters in all: what one block may send to a worker.
BLOCK_NAMES, BLOCK_CHARS = 200_000, 8 << 20


def blocks_of(names: DataFrame, name: str, place: str) -> Iterator[list[tuple[str, int]]]:
    """The names with their places, a bounded block at a time."""
    first = names.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(place).cast("long").alias("place"))
    held, size = [], 0
    for r in first.orderBy("place").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[0])
        if len(held) >= BLOCK_NAMES or size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def names_in(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name: str, place: str) -> DataFrame:
    """A row (id, place) for every name in every text, each name once. ``place`` orders the names: the least is the first name of a text."""
    spark = ship_package(texts.sparkSession)
    kind = texts.schema[id_col].dataType.simpleString()
    found = None
    for block in blocks_of(names, name, place):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            everywhere = [k for k, (n, _) in enumerate(sent.value) if not n]
            machine = ahocorasick.Automaton()
            for k, (n, _) in enumerate(sent.value):
                if n:
                    machine.add_word(n, k)
            machine.make_automaton()
            for batch in batches:
                ids, places = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if t is None:
                        continue
                    hits = {k for _, k in machine.iter(t)} if len(machine) else set()
                    hits.update(everywhere)
                    ids += [i] * len(hits)
                    places += [sent.value[k][1] for k in hits]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(places, pa.int64())], names=[id_col, place])

        part = texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{place}` long")
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], f"`{id_col}` {kind}, `{place}` long") if found is None else found


def contained_in(rows: DataFrame, raw: str, names: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the ``value`` of the first name, in order, that holds the text of ``raw``. For names whose substrings are a small table."""
    starts = F.sequence(F.lit(1), F.length(name) + 1)
    every = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.length(name) + 1 - s), lambda n: F.substring(F.col(name), s, n))))
    table = names.filter(F.col(name).isNotNull()).select(F.explode(F.array_distinct(every)).alias("__sub"), F.struct(name, value).alias("__n"))
    table = written(table.groupBy("__sub").agg(F.min("__n").getField(value).alias(out)), "substrings")  # its measured size decides how it is joined
    return rows.join(table, F.col(raw) == F.col("__sub"), "left").drop("__sub")
