"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns documents; the last returns their token digests.  A stage's result is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import frames, jaccard, mixing, perplexity, pieces, quality


def trusted_style(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose perplexity under the trusted texts' model is outside their language's fences go."""
    return perplexity.keep(docs, frames.table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base counts or the fertility bands go."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document of the smallest id of each component stays."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents are repeated or left out as the mix takes them."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return pieces.digests(docs)


STAGES = [
    ("quality classifier", trusted_style),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", tokens),
]

#: SQL can't express the language model, the tokeniser's bands or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = frames.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
