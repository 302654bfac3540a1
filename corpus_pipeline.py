"""Corpus pipeline over `documents`: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes all its predecessor kept, written as Parquet and read again, and returns the columns of
`documents`; the last returns the packed pieces. ``run`` applies them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import decontaminate, line_dedup, packing, quality, similar
from fieldglass.llm.common import discard, fresh_path, materialise, scratch, table, unused
from fieldglass.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it is trained on the labelled ones that are not held out. Columns of any name are kept."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(unused(docs, "held_out", "score", "predicted"))
    return quality.score(docs, model, names=names).filter(F.col(names[2]) == 1).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood before, or are a word away from one, go; documents of which nothing is left go too.

    ``n_chars``, where ``docs`` has it, follows the text. Documents that lose no line stay as they are, null texts included.
    """
    count = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]  # the operator's own names: a caller's columns go round it
    aside = dict(zip(count, unused(docs, *count)))
    left = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    left = left.filter("n_removed = 0 OR length(trim(replace(text, '\n', ''))) > 0")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates, at a five-word similarity of 0.8 or more in the texts as they reach this stage; all that are in no group stay."""
    return similar.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets, without the token ids. Null and empty texts have the end token alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: A trained network decides in the first stage and a vocabulary in the last; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself, and what it read, goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            kept = materialise(stage(spark, docs, sf_dir), name, path)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
