"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
what it decides takes effect on its output. `run` writes every stage's output as
Parquet in the shared folder and reads it again.

All stages take an empty table, and columns of any names beside doc_id, text, lang
and source; all but the last return the columns that they got. What they do with
nulls, empty texts, ties and repeated rows each one states. Python workers get the
rows in small batches (`common.small_batches`), which changes no result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folio.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from folio.llm.common import drop, small_batches, stored
from folio.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification (1) accepts.

    Null and empty texts, and those without letters, are rejected; null ids and repeated rows are judged each for itself.
    """
    return language_id.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (2), that of least id; of repeated rows one. Rows with a null id or text stay."""
    return exact_dedup.without_copies(docs)


@_in_small_batches
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join (6) connects, that of least id, with all its rows.

    Rows with a null id or text, and texts of fewer words than an n-gram, are in no group and stay.
    """
    return ngram_join.without_near_copies(docs)


@_in_small_batches
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (9); of an id with several texts none stays if one contains an item. Null ids and texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, intact) of every row left (4); null for a null text, no tokens for an empty one."""
    return byte_bpe.encoded(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", no_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("byte_bpe", tokens),
]

#: Language identification is a trained model, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result is the last stage's."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            drop(last)
        last = docs
    return docs
