"""The thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licences, matroska, mixing, packing, pages, perplexity, pieces, quality, toxicity
from .frames import table, written


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "times")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(written(matroska.store(table(spark, sf_dir, "documents"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*columns, "n_tokens", "chars_per_token", "byte_share", "entropy")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumns({c: F.round(c, 6) for c in ("perplexity", "low", "high")})  # logarithms differ in last digits between machines


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": jaccard.SQL, "op2_mixing": mixing.SQL, "op10_perplexity": perplexity.SQL}
