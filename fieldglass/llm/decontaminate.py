"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits. A window has as many words as an item. A
window can only be similar to an item if at least the threshold's share of the item's shingles stand in it, so
windows are placed at every start whose window holds so many shingles of items of its size; which shingles of the
corpus are the benchmark's is found by a join on their hashes, over all documents and whole texts. Windows so left
out can't reach the threshold against any item, whatever their fingerprints. The SimHash of each window and of each
item is compared through a multi-index: fingerprints cut into ``radius + 1`` blocks, of which those within the radius
share one, joined on block and value among windows and items of one size; different fingerprints meet once, however
many windows have them. So all fingerprints within the radius meet, whatever items placed the window. What meets is
verified by the exact weighted similarity of their bags of shingles: the sum of smaller counts over that of larger counts.

At a similarity of 0.8, fingerprints differ in 10 of 64 bits on average (standard deviation 3); the radius of 20
passes more than 99.9 % of such pairs to the exact check.

A null or empty text has no windows, an item without words is no item. Items of fewer words than a shingle have one
shingle of all their words. Windows are cut at the ends of a text. Repeated rows are reported each,
equal items each. A null id is carried. An empty table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, materialise, require, unused

SHINGLE, SIMILARITY, RADIUS, WIDTH = 5, 0.8, 20, 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: Column | int) -> Column:
    """Hash of each run of ``size`` words, in order; empty if there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))

    return let(words, lambda w: F.when(F.size(w) >= size, runs(w)).otherwise(F.array().cast("array<bigint>")))


def simhash(bag: Column) -> Column:
    """Bits set in more than half of the hashes."""

    def majority(hashes: Column, b: int) -> Column:
        n = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftright(h, b).bitwiseAND(1).cast("int"))
        return F.when(n * 2 > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    def bits(hashes: Column) -> Column:
        return F.aggregate(F.array(*[majority(hashes, b) for b in range(WIDTH)]), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return let(bag, bits)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two bags of hashes."""

    def count(bag, x):
        return F.size(F.filter(bag, lambda y: y == x))

    def shared(a, b):
        return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))

    return let(a, lambda a: let(b, lambda b: let(shared(a, b), lambda n: n / (F.size(a) + F.size(b) - n))))


def blocks(bits: Column, radius: int = RADIUS) -> Column:
    """One number for each block of bits: the block and its value."""
    cuts = [WIDTH * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(F.shiftleft(bits, WIDTH - hi), WIDTH - hi + lo) + F.lit(i << 48) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def placed(at: Column, words: Column, k: Column, threshold: float) -> Column:
    """Starts of all windows of ``words`` words in which so many of the shingles at ``at`` stand as the threshold needs."""
    need = F.greatest(F.ceil((words - k + 1) * F.lit(float(threshold)) - F.lit(1e-9)).cast("int"), F.lit(1))

    def held(at: Column, need: Column) -> Column:
        def around(j: Column) -> Column:
            first, last = F.get(at, j - need + 1), F.get(at, j)
            return F.when(last - first <= words - k, F.sequence(F.greatest(last + k - words, F.lit(0)), first)).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(at) >= need, F.array_distinct(F.flatten(F.transform(F.sequence(need - 1, F.size(at) - 1), around))))

    return let(F.sort_array(at), lambda at: let(need, lambda need: held(at, need)))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start, words, similarity): the best window of each document for each item it holds."""
    items = require(benchmark, item_col, item_text).select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("iw")).filter(F.size("iw") > 0)
    items = items.withColumns({"words": F.size("iw"), "k": F.least(F.size("iw"), F.lit(shingle))})
    items = items.withColumn("bag", shingle_hashes(F.col("iw"), F.col("k"))).withColumn("bits", simhash(F.col("bag"))).drop("iw").distinct()
    items = materialise(items, "items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most `shingle` numbers
    places = bounded(items.select("words", "k", F.explode("bag").alias("h")).distinct(), "item-shingles")

    texts = require(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    found = None
    for k in sizes:
        w = words(F.col("text"))
        hashes = texts.select("id", "row", F.posexplode(shingle_hashes(w, k)).alias("p", "h"))
        hit = hashes.join(places.filter(F.col("k") == k), "h").select("id", "row", "p", "words", "k")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = texts.select("id", "row", F.lit(0).alias("p"), F.lit(0).alias("words"), F.lit(0).alias("k")).limit(0)
    hits = found.groupBy("id", "row", "words", "k").agg(F.collect_set("p").alias("at"))  # no more than the document has shingles
    starts = hits.select("id", "row", "words", "k", placed(F.col("at"), F.col("words"), F.col("k"), threshold).alias("starts"))
    starts = materialise(starts.filter(F.size("starts") > 0), "starts")

    # the windows' own shingles: only texts that have one are read again
    holders = bounded(starts.select(F.col("id").alias("id2"), F.col("row").alias("row2")).distinct(), "holders")
    read = texts.join(holders, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left_semi").dropDuplicates(["id", "row"])
    read = read.select("id", "row", words(F.col("text")).alias("w"))
    per_doc = starts.groupBy("id", "row").agg(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), "words", "k")))).alias("starts"))  # no more than the document has shingles, times items' sizes
    joined = per_doc.withColumnsRenamed({"id": "id2", "row": "row2"}).join(read, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    windows = joined.select("id", "row", "w", F.explode("starts").alias("s")).select("id", "row", "s.*", F.slice("w", F.col("s.start") + 1, F.col("s.words")).alias("ww"))
    windows = windows.withColumn("bag", shingle_hashes(F.col("ww"), F.col("k"))).filter(F.size("bag") > 0).drop("ww").withColumn("bits", simhash(F.col("bag")))
    windows = materialise(windows, "windows")

    # different fingerprints meet, once each: a passage that stands in a third of all documents is a few of them
    key = ["words", "k", "bits"]
    near = windows.select(*key).distinct().withColumn("block", F.explode(blocks(F.col("bits"), radius)))
    sought = items.select(F.col("words").alias("iwords"), F.col("k").alias("ik"), F.col("bits").alias("ibits")).distinct()
    dealt = bounded(sought.withColumn("iblock", F.explode(blocks(F.col("ibits"), radius))), "item-blocks")
    met = near.join(dealt, (F.col("words") == F.col("iwords")) & (F.col("k") == F.col("ik")) & (F.col("block") == F.col("iblock"))).filter(F.bit_count(F.col("bits").bitwiseXOR(F.col("ibits"))) <= radius)
    pairs = bounded(met.select(*key, "ibits").distinct(), "met")
    bags = bounded(items.select("item", F.col("words").alias("iwords"), F.col("bits").alias("ibits2"), F.col("bag").alias("ibag")), "bags")
    exact = (
        windows.join(pairs, key)
        .join(bags, (F.col("words") == F.col("iwords")) & (F.col("ibits") == F.col("ibits2")))
        .withColumn("similarity", similarity(F.col("bag"), F.col("ibag")))
        .filter(F.col("similarity") >= threshold)
    )
    best = exact.groupBy("id", "row", "item", "words").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("id", "row", F.col("item").alias(item_col), (-F.col("b.col2")).alias("start"), "words", "b.similarity")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """One row per row of ``docs`` and item it holds."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, **options).withColumnsRenamed({"id": "id2"})
    rows = require(docs, id_col, text_col).select(F.col(id_col).alias("id1"), F.xxhash64(text_col).alias("row1"))
    return rows.join(found, F.col("id1").eqNullSafe(F.col("id2")) & (F.col("row1") == F.col("row"))).select(F.col("id1").alias(id_col), item_col, "start", "words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; columns of any name are kept."""
    id2, row2 = unused(docs, "id", "row")
    held = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias(id2), F.col("row").alias(row2)).distinct()
    return docs.join(bounded(held, "held"), docs[id_col].eqNullSafe(F.col(id2)) & (F.xxhash64(docs[text_col]) == F.col(row2)), "left_anti")
