"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html_text, line_dedup, mixing, ngram_join, repeats, sharding, token_counts, toxicity
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select(
        "doc_id",
        "size",
        F.crc32("text").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, _read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, _read(spark, sf_dir, "labels").where(~_held_out()))
    out = toxicity.score(docs, model)
    out = out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
    # scored as it is written, so that the kernel gets batches of bounded bytes
    return Scratch(spark, "toxicity").table(out, "scores")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(spark, _read(spark, sf_dir, "documents"), n=3, percent=90)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the item that covers each best."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.coverage(spark, docs, _read(spark, sf_dir, "benchmark"))
    return out.where(F.col("coverage") >= decontamination.THRESHOLD).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(spark, _read(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(spark, docs)
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(spark, _read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "section_tokens")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_fingerprints": op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {}
