"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage works on all that the one before kept and gives the columns of documents; the last gives token digests.
SQL can't express the field of the first stage nor the fingerprints of the second: ORACLE_SQL is None, and the tests
hold the stages against brute force.

Null texts count as empty everywhere; they and empty texts are one group of near duplicates, of which one document stays,
and take no part in the mix, which repeats words. Rows without a doc_id can't be told apart, so the second stage keeps them
all. Repeated rows (same id and text) are one document after the second stage. Null sources are a source of their own, long
texts are taken whole, columns beyond those of documents are handed through up to the last stage, and an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import bpe, common, mixing, pii, simhash, toxicity

ORACLE_SQL: str | None = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id."""
    return simhash.keep_one(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix of sources takes them."""
    return mixing.remix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("pii", personal_data_out),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables go as soon as its result is written; the last one's stay for the caller."""
    docs, first = common.table(spark, sf_dir, "documents"), common.written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{name}")
            common.release(first, common.written() - 1)
    return docs
