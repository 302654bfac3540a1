"""The thin queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lexical, line_dedup, media_gif, neighbours, packing, quality, secret_scan, simhash, token_counts, url_filter, vector_codes, warc
from .common import fresh_path, materialise, scratch, table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on this machine; the files are part of every machine's Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query's result, written; all else that it wrote to the shared folder goes. For results that are small beside their input."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, query.__name__)
        with scratch(spark):
            return materialise(query(spark, sf_dir), query.__name__, path)

    return run


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@settled
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@settled
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@settled
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.media_columns(table(spark, sf_dir, "documents"))


@settled
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@settled
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), every=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_decontamination,
        op3_best_fit_packing,
        op4_simhash_dedup,
        op5_warc,
        op6_quality_classifier,
        op7_line_dedup,
        op8_secret_scan,
        op9_token_counts,
        op10_media_gif,
        op11_vector_codes,
        op12_lexical_search,
        op13_nearest_neighbours,
    )
}
ORACLE = {"op1_url_filter": url_filter.oracle(), "op5_warc": warc.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op11_vector_codes": vector_codes.oracle(), "op12_lexical_search": lexical.ORACLE}
