"""A training-data pipeline: quality rules, near-duplicates, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept. run() writes each result as Parquet to the shared
folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, decontaminate, pii, quality, simhash
from lexmill.llm.common import saved, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word counts and the tokenisers' bands.

    Null, empty and short texts go. Repeated rows are judged, and kept, each.
    Bands are learnt from all documents, so what becomes of one may depend on
    which others are in the table.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, then the smallest digest of its text.

    Repeated rows are one. Null and empty texts are copies of each other; rows
    without a doc_id come last in their group.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and empty texts hold none, and repeated rows are judged alike."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind, n_chars following; null and empty texts stay as they are, repeated rows change alike."""
    return pii.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; null and empty texts have no token."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

#: Fingerprint classes, learnt patterns and token ids are not SQL's; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; an empty table gives none. What the stages wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), outlives=name == STAGES[-1][0])
    return docs
