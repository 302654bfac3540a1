"""Ranked lexical search over a table of postings.

``build`` tokenises whole documents and writes one posting per document and term: its occurrences there and the
document's length. The table is partitioned by ``bucket``, a hash of the term, and bucketed by document, so a search
reads the buckets of its terms only and adds up a document's matches where they lie. ``search`` joins the items' terms
to the postings, scores each match in integers, sums by item and document, and keeps the best k of a window per item;
each task gives at most k rows of an item to the last exchange. A frequent term is spread over all document buckets,
so no task holds a term whole.

The items' terms with their weights are broadcast when they are measured to be small; otherwise the join shuffles by
term and the sums by document follow in a shuffle of their own, with the same result.

Defined results: null and empty texts have no terms and count neither as documents nor in lengths. Each row of
``docs`` is a document of its own, also where ids repeat or are null (nulls sort first among equal scores). Rows that
repeat an item id are one item whose terms add up. Items without terms, and items that match nothing, give no rows.
An empty table of documents or items gives no rows. Other columns of either table are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, LOWER_BYTES, bounded, fresh_path, materialise, remove, require, slices

#: On UTF-8 bytes: ASCII letters and digits, and every byte of a character beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOP = 20
#: Term buckets of a postings table; the row of a document's length has a bucket of its own.
BUCKETS, LENGTHS = 8, -1
#: Rows of postings in one Arrow batch.
BATCH = 1 << 16

POSTING = "row long, doc_id long, term string, tf long, n long"


def term_counts(text: bytes) -> Counter:
    return Counter(TERM.findall(text.translate(LOWER_BYTES)))


def terms_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """One row per document and term, and one with an empty term and the document's length; ``vocabulary`` keeps other terms back, lengths count them all."""
    source = require(docs, id_col, text_col).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "term", "tf", "n"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        held: list[list] = [[], [], [], [], []]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held[2], pa.binary()).cast(pa.string()) if k == 2 else pa.array(held[k], kinds[k]) for k in range(5)], names=names)
            for column in held:
                column.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, 2)):
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = term_counts(text.as_py() or b"")
                if not found:
                    continue
                n = found.total()
                kept = found if vocabulary is None else {t: found[t] for t in (found.keys() & vocabulary)}
                for column, values in zip(held, ([row] * (len(kept) + 1), [doc] * (len(kept) + 1), [b"", *kept], [0, *kept.values()], [n] * (len(kept) + 1))):
                    column.extend(values)
                if len(held[0]) >= BATCH:
                    yield flush()
        if held[0]:
            yield flush()

    return source.mapInArrow(postings, POSTING)


def count_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Terms of few texts by id: (id, term, times)."""
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count("*").alias("times"))


@dataclass(frozen=True)
class Postings:
    """A written index: its table's name and path, the number of documents with a term and of all their terms."""

    name: str
    path: str
    documents: int
    length: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).filter(F.col("bucket") != LENGTHS)

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(spark, self.path)


def bucket_of(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: frozenset[bytes] | None = None, parts: int | None = None) -> Postings:
    """Write the postings of all documents, of the terms of ``vocabulary`` only where one is given. ``parts``: document buckets, as many as shuffle partitions unless stated."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "postings")
    name = "postings_" + path.rsplit("-", 1)[1]
    keyed = terms_of(docs, id_col, text_col, vocabulary).withColumn("bucket", F.when(F.col("term") == "", LENGTHS).otherwise(bucket_of("term")))
    keyed.repartition(parts, "row").write.partitionBy("bucket").bucketBy(parts, "row").option("path", path).saveAsTable(name)
    documents, length = spark.table(name).filter(F.col("bucket") == LENGTHS).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Postings(name, path, documents, length)


def weights(spark: SparkSession, index: Postings, items: DataFrame) -> DataFrame:
    """(item_id, bucket, term, weight): an item's terms that occur in documents, weighted and multiplied by their repeats."""
    wanted = items.select("term").distinct()
    df = index.rows(spark).join(F.broadcast(wanted) if getattr(items, "_small", False) else wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    return items.join(df, "term").select("item_id", bucket_of("term").alias("bucket"), "term", (weight * F.col("times")).alias("weight"))


def search(spark: SparkSession, index: Postings, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score. ``items``: (item_id, term, times), as ``count_terms`` gives them."""
    weighted = bounded(weights(spark, index, items).filter("weight > 0"), "item-weights")
    mean = F.lit(max(index.length, 1))
    m = F.lit(75) + F.call_function("div", F.col("n") * F.lit(25 * index.documents), mean)
    impact = F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 12 * m)
    scored = index.rows(spark).select("row", "doc_id", "bucket", "term", impact.alias("impact"))
    sums = scored.join(weighted, ["bucket", "term"]).groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("impact") * F.col("weight")).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    return sums.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` for the terms of ``items`` and search them; the result is written, the index and the items' terms go."""
    spark = docs.sparkSession
    terms = materialise(count_terms(items, item_id, text_col), "item-terms")
    rows, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()
    terms._small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    vocabulary = frozenset(r.term.encode() for r in terms.select("term").distinct().toLocalIterator()) if terms._small else None
    index = build(docs, doc_id, text_col, vocabulary)
    try:
        return materialise(search(spark, index, terms, top), "ranked")
    finally:
        index.drop(spark)
        remove(spark, terms._stored_at)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
u AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM t WHERE len(ts) > 0),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(ts) AS term FROM u) GROUP BY ALL),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term, docs),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN items USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
