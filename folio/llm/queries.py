"""The queries of the ten operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import byte_bpe, decontaminate, exact_dedup, html_extract, language_id, line_dedup, ngram_join, repeats, toxicity, url_filter
from folio.llm.common import small_batches
from folio.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and rejection of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundant copies of `documents` and the document kept in their place."""
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines, and how many those were."""
    return line_dedup.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether decoding them gives the text back."""
    return byte_bpe.encoded(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and its number of links: others whose word-bigram sets have a Jaccard similarity of 0.6 or more with its own."""
    small_batches(spark)
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in `documents` where a maximal repeat of 50 words or more starts, with the repeats that start there."""
    return repeats.maximal(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic, with their scores."""
    return toxicity.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of `benchmark` that a document contains to 60 % or more in one window."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with its probability to be unwanted, and the decision."""
    return url_filter.judged(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op6_ngram_jaccard_join": ngram_join.sql(),
    "op9_decontamination": decontaminate.sql(),
}
