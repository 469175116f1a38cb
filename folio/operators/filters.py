"""Paragraph and sample filters: bibliographies, headers, artifacts, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import lexicons, text

HEADER = r"(?i)^(figure|table|references|bibliography|[0-9]+\.?\s*$)"
REFERENCES = r"(?i)^(references|bibliography)"


def _points(column: Column, tests: list) -> Column:
    total = F.lit(0)
    for pattern, steps in tests:
        n = text.count_of(column, pattern)
        points = F.lit(0)
        for least, value in reversed(steps):
            points = F.when(n >= least, value).otherwise(points)
        total = total + points
    return total


def bibliography_a(column: Column) -> Column:
    """Points of the first bibliography test; 3 make a reference list, short texts have 0."""
    journals = reduce(lambda a, b: a + b, [text.count_of(column, p) for p in lexicons.JOURNALS_A])
    return F.when(F.length(column) < 100, 0).otherwise(_points(column, lexicons.BIBLIOGRAPHY_A) + F.when(journals >= 3, 1).otherwise(0)).cast("int")


def bibliography_b(column: Column) -> Column:
    """Points of the second bibliography test; 3 make a reference list, short texts have 0."""
    return F.when(F.length(column) < 100, 0).otherwise(_points(column, lexicons.BIBLIOGRAPHY_B)).cast("int")


def artifacts(column: Column) -> Column:
    """How often any artifact occurs."""
    return reduce(lambda a, b: a + b, [text.count_with(column, F.lower(column), part, "(?i)" + p) for p, part in zip(lexicons.ARTIFACTS, lexicons.ARTIFACT_PARTS)])


def without_artifacts(column: Column) -> Column:
    """Artifacts removed in order, wide gaps narrowed to two blanks, stripped."""
    less, lower = column, F.lower(column)
    for p in lexicons.ARTIFACTS:
        less = F.regexp_replace(less, "(?i)" + p, "")
    some = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(part)) for part in dict.fromkeys(lexicons.ARTIFACT_PARTS)])
    return text.let(F.regexp_replace(F.when(some, less).otherwise(column), r"\s{3,}", "  "), text.stripped)


def paragraphs(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, pos, para): the squeezed, non-empty pieces of every document, places from 0."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("pos", "para"))
    return rows.withColumn("para", text.squeezed(F.col("para"))).where("para <> ''")


def kept_paragraphs(rows: DataFrame, least: int = 20) -> DataFrame:
    """Paragraphs of `least` words or more that are no headers, bibliographies or mostly numbers.

    From the first such paragraph that begins like a reference section on, a document has none.
    """
    words = F.split("para", " ")
    long = rows.where(F.size(words) >= least)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = long.withColumn("_cut", F.max(F.col("para").rlike(REFERENCES).cast("int")).over(before)).where("_cut = 0").drop("_cut")
    numbers = F.size(F.filter(words, lambda w: w.rlike("^[0-9.,]+$")))
    return seen.where(~F.col("para").rlike(HEADER) & (bibliography_a(F.col("para")) < 3) & (numbers <= F.size(words) * 0.5))


def sample_outcome(column: Column, longest: int = 4000) -> Column:
    """contaminated, too_short, too_long or kept."""
    return outcome(artifacts(column), F.length(without_artifacts(column)), longest)


def outcome(found: Column, clean: Column, longest: int = 4000) -> Column:
    """`sample_outcome` from the artifacts and the length without them."""
    return F.when(found > 3, "contaminated").when(clean < 50, "too_short").when(clean > longest, "too_long").otherwise("kept")


def section(column: Column) -> Column:
    """The section whose words the first 300 characters hold most of; null below two (Methods: one)."""
    head = F.lower(F.substring(column, 1, 300))
    counts = [(name, reduce(lambda a, b: a + b, [F.contains(head, F.lit(w)).cast("int") for w in words])) for name, words in lexicons.SECTIONS]
    most = F.greatest(*(c for _, c in counts))
    out = F.lit(None).cast("string")
    for name, c in reversed(counts):
        out = F.when((c == most) & (c >= (1 if name == "Methods" else 2)), name).otherwise(F.when(c == most, None).otherwise(out))
    return out


def pair_candidate(column: Column) -> Column:
    """Whether a text may become a style pair."""
    return column.rlike(r"^\p{L}") & column.contains(". ") & ~column.contains("http") & ~F.substring(column, 1, 20).contains("10.1") & (bibliography_b(column) < 3)
