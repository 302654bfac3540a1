"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared word by word: the edit bound is one word put in, taken out or changed, at a similarity of at
least 0.8, that is one word of the ``near_words`` = 5 or more of the longer line. Each line gives, as hashed keys, itself and every variant with one word left out; two lines are within the bound if and
only if one is a variant of the other, or both have equal variants with the same word left out. So
the earliest line of each key (and of each key and place) is found by aggregation, joined to the equal
variants, and the edit distance of each line and the earlier one is verified on their words. A line goes
if an equal line, or one within the bound, stands earlier (by id, then by place in the text).

Variants are emitted only for lines that can have a partner: lines one edit apart share the first or the
last half of their words, so a line whose halves are its own alone is left out without loss. What goes to
the join is hashes and places; a line that stands in a third of all documents is one row after partial
aggregation, and is never joined by its occurrences: the places that stay are what is joined back.

So a line of four words is within the bound of lines of five alone, and shorter lines only of equal ones: in "the end" and
"the start" one word is half the line. Lines without a word always stay. Null text stays null. Rows equal in id and
text are one document and get the same result; a null id comes before all others. A text of any length is read whole;
other columns are kept whatever their names, but for ``n_lines`` and ``n_removed``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, materialise, require, unused

#: Words of the longer line from which one word is at most a fifth.
NEAR_WORDS = 5


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return require(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """id, row, at, line of every line that has a word."""
    return rows.select("id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.length(F.trim("line")) > 0)


def words(line: Column) -> Column:
    return F.split(line, " ")


def within_one(a: Column, b: Column) -> Column:
    """Whether the word edit distance of arrays ``a`` and ``b`` is at most one."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    left_out = F.exists(F.sequence(F.lit(1), F.size(longer)), lambda i: F.concat(F.slice(longer, F.lit(1), i - 1), F.slice(longer, i + 1, F.size(longer))) == shorter)
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(longer) == F.size(shorter) + 1, left_out).otherwise(False)


def earliest(docs: DataFrame, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, at) of the lines that stay."""
    rows = keyed(docs, id_col, text_col)
    lines = lines_of(rows)
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n)
    place = F.struct("id", "row", "at").alias("place")
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), place, *half_keys(near_words))
    names = [f"k{i}" for i in range(4)]
    texts = materialise(hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(k).alias(k) for k in names]), "lines")

    # lines that share a half with another line
    shared = texts.select("h1", "h2", "place", F.explode(F.array_distinct(F.filter(F.array(*names), lambda k: k.isNotNull()))).alias("key"))
    popular = bounded(shared.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key"), "halves")
    likely = bounded(shared.join(popular, "key", "left_semi").select("place").distinct().select("place.*"), "likely")
    found = lines_of(rows).join(likely.withColumnsRenamed({"id": "id2", "row": "row2", "at": "at2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")) & (F.col("at") == F.col("at2")), "left_semi")
    found = materialise(found.dropDuplicates(["id", "row", "at"]), "candidates")

    # their variants; `out` is the word left out, -1 where none is
    w = words(F.col("line"))
    outs = F.when(F.size("w") >= near_words, F.sequence(F.lit(-1), F.size("w") - 1)).otherwise(F.array(F.lit(-1)))
    spread = found.select(place, w.alias("w")).select("place", "w", F.explode(outs).alias("out"))
    variant = F.when(F.col("out") < 0, F.array_join("w", " ")).otherwise(F.concat_ws(" ", F.slice("w", F.lit(1), F.greatest(F.col("out"), F.lit(0))), F.slice("w", F.col("out") + 2, F.size("w"))))
    variants = spread.select("place", "out", variant.alias("v")).select("place", "out", F.xxhash64("v").alias("v1"), F.xxhash64(F.lit(1), "v").alias("v2"))
    variants = materialise(variants, "variants")
    met = bounded(variants.groupBy("v1").agg(F.count("*").alias("c")).filter("c > 1").select("v1"), "met")
    variants = materialise(variants.join(met, "v1", "left_semi"), "met-variants")  # those that any other line has too
    left_out = F.col("out") >= 0
    by_place = variants.filter(left_out).groupBy("v1", "v2", "out").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    by_key = variants.groupBy("v1", "v2").agg(F.min(F.when(~left_out, F.col("place"))).alias("plain"), F.min(F.when(left_out, F.col("place"))).alias("cut")).filter("plain IS NOT NULL AND cut IS NOT NULL")
    same_place = variants.join(by_place, ["v1", "v2", "out"]).select("place", "first")
    plain_or_cut = variants.join(by_key, ["v1", "v2"]).select("place", F.when(left_out, F.col("plain")).otherwise(F.col("cut")).alias("first"))
    pairs = same_place.union(plain_or_cut).filter("first < place").distinct()
    texts_of = found.select(place, F.col("line"))
    verified = (
        pairs.join(texts_of, "place")
        .withColumnRenamed("line", "a")
        .join(texts_of.withColumnsRenamed({"place": "first", "line": "b"}), "first")
        .filter(let(words(F.col("a")), lambda a: let(words(F.col("b")), lambda b: within_one(a, b))))
        .select("place")
        .distinct()
    )
    return texts.select("place").join(verified, "place", "left_anti").select("place.*")


def half_keys(near_words: int) -> list[Column]:
    """k0 to k3: hashes of the first and of the last half of a line's words, for both roundings of half; null for lines too short for a partner."""
    out = []
    for i, half in enumerate((F.expr("(n - 1) div 2"), F.expr("n div 2"))):
        half = half.cast("int")
        for end, count in ((0, half), (1, -half)):
            out.append(F.when(F.col("n") >= near_words - 1, F.xxhash64(F.lit(end), half, F.call_function("substring_index", F.col("line"), F.lit(" "), count))).alias(f"k{2 * i + end}"))
    return out


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as its text, and n_lines, n_removed (columns of these names are replaced)."""
    new = ("n_lines", "n_removed")
    kept = [c for c in docs.columns if c.lower() not in new]
    row, id2, row2, at, left = unused(docs, "row", "id2", "row2", "at", "left")
    stays = earliest(docs, near_words, id_col, text_col).groupBy(F.col("id").alias(id2), F.col("row").alias(row2)).agg(F.collect_set("at").alias(at))
    body = docs.select(*kept).withColumn(row, F.xxhash64(id_col, text_col))
    joined = body.join(stays, F.col(id_col).eqNullSafe(F.col(id2)) & (F.col(row) == F.col(row2)), "left")
    lines = F.split(text_col, "\n")
    out = joined.withColumn(left, F.filter(lines, lambda line, i: (F.length(F.trim(line)) == 0) | F.coalesce(F.array_contains(at, i), F.lit(False))))
    counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": F.coalesce(F.size(lines) - F.size(left), F.lit(0))}
    return out.withColumns(counts).withColumn(text_col, F.array_join(left, "\n")).select(*kept, *new)


ORACLE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
    w AS (SELECT *, string_split(line, ' ') AS w FROM l WHERE length(trim(line, ' ')) > 0),
    t AS (SELECT line, any_value(w) AS w, min(struct_pack(doc_id := doc_id, pos := pos)) AS place FROM w GROUP BY line),
    c AS (SELECT *, unnest(CASE WHEN len(w) >= {NEAR_WORDS} THEN range(0, len(w) + 1) ELSE [0] END) AS out FROM t WHERE len(w) >= {NEAR_WORDS} - 1),
    v AS (SELECT line, place, out, CASE WHEN out = 0 THEN line ELSE array_to_string(list_concat(w[1:out - 1], w[out + 1:]), ' ') END AS v FROM c),
    f AS (SELECT v, out, min(place) AS first FROM v GROUP BY v, out),
    gone AS (
        SELECT DISTINCT v.line FROM v JOIN f ON v.v = f.v AND (v.out = f.out OR v.out = 0 OR f.out = 0) WHERE f.first < v.place),
    stays AS (SELECT place.doc_id AS doc_id, place.pos AS pos FROM t WHERE line NOT IN (SELECT line FROM gone)),
    n AS (
        SELECT l.r, string_agg(line, chr(10) ORDER BY l.pos) FILTER (length(trim(line, ' ')) = 0 OR s.pos IS NOT NULL) AS text,
               count(*) AS n_lines, count(*) FILTER (length(trim(line, ' ')) > 0 AND s.pos IS NULL) AS n_removed
        FROM l LEFT JOIN stays s ON l.doc_id = s.doc_id AND l.pos = s.pos GROUP BY l.r)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(n.text, '') END AS text, coalesce(n.n_lines, 0)::INTEGER AS n_lines, coalesce(n.n_removed, 0)::INTEGER AS n_removed
    FROM d LEFT JOIN n USING (r)"""
