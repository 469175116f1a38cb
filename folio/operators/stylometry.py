"""Scores of single texts and the style fingerprint of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import lexicons, text

PASSIVE = r"(?i)\b(was|were|been|being|is|are)\s+[\p{L}\p{N}_]+ed\b"
HEDGE = r"(?i)\b(may|might|could|possibly|potentially|likely|suggest|appear|seem)\b"
#: The same matches, found sooner: first the letter that a match begins with.
PASSIVE_FAST, HEDGE_FAST = "(?i)(?=[wbia])" + PASSIVE[4:], "(?i)(?=[mcplsa])" + HEDGE[4:]


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _found(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(words)))


def _entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h): entropy in bits of the character pairs of each text; null of a null text and below two characters."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        codes = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
        seen[codes] = True
        code, kinds, at, out = (np.cumsum(seen) - 1)[codes], int(seen.sum()), 0, []
        for x in texts:
            own, at = code[at : at + len(x or "")], at + len(x or "")
            if len(own) < 2:
                out.append(None)
                continue
            pairs = own[:-1] * kinds + own[1:]
            k = np.bincount(pairs) if kinds * kinds <= 1 << 16 else np.unique(pairs, return_counts=True)[1]
            k = k[k > 0].astype(float)
            out.append(float(np.log2(len(pairs)) - (k * np.log2(k)).sum() / len(pairs)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "h"])


def perplexity(docs: DataFrame) -> DataFrame:
    """(doc_id, perplexity): 3.5 times two to the entropy of the lower text's character pairs; 30 below 50 characters.

    Rows that repeat an id have the entropy of all their pairs together, a null id has 30.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.length("text") >= 50), F.lower("text")).alias("text")).mapInArrow(_entropies, f"doc_id {kind}, h double")
    repeated = F.broadcast(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1 AND doc_id IS NOT NULL").select("doc_id"))
    rows = each.join(_entropy_by_id(docs.join(repeated, "doc_id", "left_semi")).withColumnRenamed("h", "_h"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.round(F.lit(3.5) * F.pow(F.lit(2.0), F.coalesce("_h", "h")), 2), F.lit(30.0)).alias("perplexity"))


def _entropy_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, h) of the character pairs of all rows of an id."""
    chars = docs.select("doc_id", F.length("text").alias("n"), F.filter(F.split(F.lower("text"), ""), lambda c: c != "").alias("c"))
    pairs = chars.where("n >= 50").select("doc_id", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("p"))
    counts = pairs.groupBy("doc_id", "p").agg(F.count(F.lit(1)).cast("double").alias("k"))
    return counts.groupBy("doc_id").agg((F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("h"))


def burstiness(column: Column) -> Column:
    """Variation of the sentence lengths; 0.35 of fewer than three sentences with words."""
    lengths = F.filter(F.transform(text.detector_sentences(column), lambda s: F.size(text.plain_words(s)).cast("double")), lambda n: n > 0)

    def varied(n: Column) -> Column:
        spread = lambda mean: F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(n)
        return F.when(F.size(n) < 3, 0.35).otherwise(text.let(F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.size(n), lambda mean: F.round(F.sqrt(spread(mean)) / mean, 3)))

    return text.let(lengths, varied)


def diversity(words: Column) -> Column:
    """Mean share of distinct words in windows of 100, every 50; 0.5 below 20 words."""

    def varied(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 100, F.lit(0)), F.lit(50)), lambda i: F.size(F.array_distinct(F.slice(w, i + 1, 100))) / F.lit(100.0))
        mean = text.let(windows, lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x))
        return F.when(n < 20, 0.5).when(n <= 100, F.round(F.size(F.array_distinct(w)) / n, 3)).otherwise(F.round(mean, 3))

    return text.let(words, varied)


def _hits(column: Column, name: str, pattern: str) -> Column:
    return text.count_with(column, F.lower(column), lexicons.PARTS[name], "(?i)" + pattern)


def pattern_score(column: Column) -> Column:
    """Weights of the phrases found, each up to three times, at most 1."""
    parts = [F.least(_hits(column, name, p), F.lit(3)) * F.lit(w) for name, p, w in lexicons.PATTERNS]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def pattern_issues(column: Column) -> Column:
    """The names of the phrases found, in the lexicon's order."""
    return F.filter(F.array(*(F.when(_hits(column, name, p) > 0, name) for name, p, _ in lexicons.PATTERNS)), lambda x: x.isNotNull())


def _falling(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - (x - low) / F.lit(high - low)))


def scores(docs: DataFrame, style: float = 0.5) -> DataFrame:
    """Perplexity, burstiness, diversity, pattern score, overall score, confidence and label of every text.

    `style` is the consistency with a fingerprint (0.5: there is none). A text of fewer
    than 50 stripped characters has score 0.5 and confidence 0.2.
    """
    words = docs.select("doc_id", "text", text.plain_words(F.col("text")).alias("w"))
    base = words.select(
        "doc_id", F.length(text.stripped(F.col("text"))).alias("n"), F.size("w").alias("words"), burstiness(F.col("text")).alias("burstiness"),
        diversity(F.col("w")).alias("diversity"), F.round(pattern_score(F.col("text")), 3).alias("pattern"),
    ).join(perplexity(docs), "doc_id")
    p, b, v = _falling(F.col("perplexity"), 15, 60), _falling(F.col("burstiness"), 0.25, 0.45), _falling(F.col("diversity"), 0.4, 0.7)
    rows = base.select("*", p.alias("p"), b.alias("b"), v.alias("v"))
    mean = (F.col("p") + F.col("b") + F.col("v")) / 3
    variance = ((F.col("p") - mean) ** 2 + (F.col("b") - mean) ** 2 + (F.col("v") - mean) ** 2) / 3
    score = F.lit(0.25) * F.col("p") + F.lit(0.3) * F.col("b") + F.lit(0.2) * F.col("v") + F.lit(0.15) * F.lit(1 - style) + F.lit(0.1) * F.col("pattern")
    sure = F.lit(0.4) * F.least(F.lit(1.0), F.col("words") / F.lit(200.0)) + F.lit(0.6) * F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(2.0) * variance)
    short = F.col("n") < 50
    out = rows.select("doc_id", "perplexity", "burstiness", "diversity", "pattern", F.when(short, 0.5).otherwise(F.round(score, 3)).alias("score"), F.when(short, 0.2).otherwise(F.round(sure, 3)).alias("confidence"))
    s = F.col("score")
    return out.withColumn("likely", s > 0.5).withColumn("risk", F.when(s < 0.25, "low").when(s < 0.5, "moderate").when(s < 0.75, "high").otherwise("very_high"))


def metrics(docs: DataFrame) -> DataFrame:
    """Sentence, vocabulary and marker measures of the texts of 50 characters or more with words."""
    rows = docs.where(F.length("text") >= 50).select("doc_id", "text", text.plain_words(F.col("text")).alias("w"), F.transform(text.clauses(F.col("text")), lambda s: F.size(text.tokens(s)).cast("double")).alias("s")).where("size(w) > 0 AND size(s) > 0")
    n, k = F.size("w"), F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / k
    variance = text.let(mean, lambda m: F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / k)
    pairs = F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: a.isin(lexicons.AUXILIARIES) & b.isin(lexicons.PASSIVE_VERBS))
    return rows.select(
        "doc_id", F.round(mean, 4).alias("sentence_mean"), F.array_max("s").cast("long").alias("sentence_max"),
        F.round(variance, 4).alias("sentence_variance"),
        F.round(F.size(F.array_distinct("w")) / n, 4).alias("richness"),
        *(F.round(_found(F.col("w"), words) / n * 100, 4).alias(name) for name, words in (("discourse", lexicons.DISCOURSE), ("subordination", lexicons.SUBORDINATORS), ("hedging", lexicons.HEDGES), ("precision", lexicons.PRECISION))),
        F.when(n < 2, 0).otherwise(F.size(F.filter(pairs, lambda x: x))).cast("long").alias("passive"),
        reduce(lambda a, b: a + b, [F.contains(F.lower("text"), F.lit(p)).cast("long") for p in lexicons.PHRASES]).alias("transitions"),
        n.cast("long").alias("words"), k.cast("long").alias("sentences"),
    )


def _band(x: str, steps: list[tuple[float, int]]) -> Column:
    out = F.when(F.col(x) > 0, 5).otherwise(0)
    for least, points in reversed(steps):
        out = F.when(F.col(x) >= least, points).otherwise(out)
    return out


def style_score(measured: DataFrame) -> DataFrame:
    """(doc_id, style_score) from `metrics`: six banded parts, 100 at most."""
    mean, hedge, moved = F.col("sentence_mean"), F.col("hedging"), F.col("transitions")
    total = (
        F.when(mean.between(20, 30), 20).when(mean.between(15, 35), 10).when(mean > 10, 5).otherwise(0)
        + _band("discourse", [(1.0, 20), (0.5, 15), (0.2, 10)]) + _band("subordination", [(4.0, 20), (3.0, 15), (2.0, 10)])
        + F.when(hedge.between(0.5, 2.0), 15).when(hedge.between(0.2, 3.0), 10).when(hedge > 0, 5).otherwise(0)
        + _band("precision", [(0.5, 15), (0.2, 10)]) + F.when(moved >= 2, 10).when(moved >= 1, 5).otherwise(0)
    )
    band = F.when(F.col("style_score") >= 70, "high").when(F.col("style_score") >= 40, "medium").otherwise("low")
    return measured.select("doc_id", total.cast("long").alias("style_score")).withColumn("band", band)


def sentence_stats(docs: DataFrame) -> DataFrame:
    """One row of the corpus: sentence lengths in plain words, and shares of short, middle and long ones."""
    n = docs.select(F.explode(text.fingerprint_sentences(F.col("text"))).alias("s")).select(F.size(text.plain_words(F.col("s"))).alias("n")).where("n > 0")
    return n.agg(
        F.count(F.lit(1)).alias("sentences"), F.round(F.avg("n"), 1).alias("mean_length"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.stddev_pop("n"), 1).alias("deviation"),
        F.round(F.avg((F.col("n") < 10).cast("double")), 3).alias("short"), F.round(F.avg(F.col("n").between(10, 25).cast("double")), 3).alias("middle"), F.round(F.avg((F.col("n") > 25).cast("double")), 3).alias("long"),
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """One row: words, distinct share and mean length of the corpus."""
    w = docs.select(F.explode(text.plain_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return w.agg(F.sum("k").alias("words"), F.round(F.count(F.lit(1)) / F.sum("k"), 3).alias("unique_ratio"), F.round(F.sum(F.length("w") * F.col("k")) / F.sum("k"), 2).alias("mean_length"))


def favourites(docs: DataFrame) -> DataFrame:
    """(list, word, uses, rank): most used words of each lexicon that occur; of the avoided list those that never do."""
    spark = docs.sparkSession
    lists = [("verbs", lexicons.VERBS, 15), ("adjectives", lexicons.ADJECTIVES, 15), ("transitions", lexicons.TRANSITIONS, 10), ("avoided", lexicons.AVOIDED, 99)]
    words = F.broadcast(spark.createDataFrame([(n, w, top) for n, ws, top in lists for w in ws], "list string, word string, top int"))
    used = docs.select(F.explode(text.plain_words(F.col("text"))).alias("word")).join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    rows = words.join(used, "word", "left").select("list", "word", "top", F.coalesce("uses", F.lit(0)).alias("uses")).where("(uses > 0) <> (list = 'avoided')")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("uses"), "word"))
    return rows.withColumn("rank", rank).where("rank <= top").select("list", "word", "uses", "rank")


def structure(docs: DataFrame) -> DataFrame:
    """One row: passive and question shares, hedges per 100 words, citation style, sentences per text."""
    s = text.fingerprint_sentences(F.col("text"))
    rows = docs.select(
        F.size(s).alias("s"), F.size(F.filter(s, lambda x: x.rlike(PASSIVE_FAST))).alias("p"), F.size(F.filter(s, lambda x: F.contains(x, F.lit("?")))).alias("q"),
        text.count_of(F.col("text"), HEDGE_FAST).alias("h"), F.size(text.plain_words(F.col("text"))).alias("w"),
        F.col("text").rlike(r"\([A-Z][a-z]+(\s+(et al\.)?)?,?\s*[0-9]{4}\)").cast("int").alias("a"), F.col("text").rlike(r"\[[0-9]+\]").cast("int").alias("b"),
    )
    share = lambda x, y, d: F.round(F.when(F.sum(y) > 0, F.sum(x) / F.sum(y)).otherwise(0.0), d)
    return rows.agg(
        share("p", "s", 3).alias("passive_ratio"), share("q", "s", 3).alias("question_ratio"), F.round(F.when(F.sum("w") > 0, F.sum("h") / F.sum("w") * 100).otherwise(0.0), 2).alias("hedges"),
        F.when((F.sum("a") == 0) & (F.sum("b") == 0), "unknown").when(F.sum("a") >= F.sum("b"), "author_year").otherwise("numbered").alias("citations"), F.round(F.avg("s"), 1).alias("sentences"),
    )


def openings(docs: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """(phrase, uses, rank): first three words of sentences used more than `least` times; ties by the phrase."""
    words = docs.select(F.explode(text.fingerprint_sentences(F.col("text"))).alias("s")).select(text.parts(F.col("s")).alias("w")).where("size(w) >= 3")
    uses = words.groupBy(F.lower(F.array_join(F.slice("w", 1, 3), " ")).alias("phrase")).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > least)
    return uses.orderBy(F.desc("uses"), "phrase").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("uses"), "phrase")))


def consistency(docs: DataFrame, mean_length: float, deviation: float, verbs: list[str]) -> DataFrame:
    """(doc_id, consistency): mean closeness of sentence length and verbs to a fingerprint; `closeness` has all four parts."""
    s = text.detector_sentences(F.col("text"))
    lengths = F.transform(s, lambda x: F.size(text.plain_words(x)).cast("double"))
    rows = docs.select("doc_id", lengths.alias("n"), text.plain_words(F.col("text")).alias("w"))
    mean = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")
    length = F.when(F.size("n") > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean - mean_length) / (deviation * 2)))
    verb = F.least(F.lit(1.0), F.size(F.array_intersect(F.array_distinct("w"), _words(verbs))) / F.lit(float(len(verbs))) * 2)
    return rows.select("doc_id", F.round((F.coalesce(length, F.lit(0.0)) + verb) / (length.isNotNull().cast("int") + 1), 3).alias("consistency"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row of the corpus: mean_length, deviation, verbs, transitions, passive_ratio."""
    top = favourites(docs)
    of = lambda name: F.coalesce(F.collect_list(F.when(F.col("list") == name, F.col("word"))), F.array().cast("array<string>")).alias(name)
    return sentence_stats(docs).select("mean_length", "deviation").crossJoin(top.agg(of("verbs"), of("transitions"))).crossJoin(structure(docs).select("passive_ratio"))


def closeness(docs: DataFrame, style: DataFrame) -> DataFrame:
    """(doc_id, closeness): mean of the closeness of sentence length, verbs, transitions and passive share to the one row of `style`.

    A part that the fingerprint lacks is left out, and the length of a text without sentences; 0.5 if none is left.
    """
    s = text.detector_sentences(F.col("text"))
    rows = docs.select("doc_id", "text", F.transform(s, lambda x: F.size(text.plain_words(x)).cast("double")).alias("n"), F.array_distinct(text.plain_words(F.col("text"))).alias("w")).crossJoin(F.broadcast(style))
    mean = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean - F.col("mean_length")) / (F.col("deviation") * 2))
    overlap = lambda words: F.when(F.size(words) > 0, F.least(F.lit(1.0), F.size(F.array_intersect("w", words)) / F.size(words).cast("double") * 2))
    share = text.count_of(F.col("text"), PASSIVE_FAST) / F.greatest(F.size("n"), F.lit(1)).cast("double")
    parts = F.array(
        F.when((F.size("n") > 0) & (F.col("deviation") > 0), near), overlap("verbs"), overlap("transitions"),
        F.when(F.col("passive_ratio") > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(share - F.col("passive_ratio")) * 2)),
    )
    scored = rows.select("doc_id", F.filter(parts, lambda x: x.isNotNull()).alias("p"))
    return scored.select("doc_id", F.when(F.size("p") == 0, 0.5).otherwise(F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p"), 3)).alias("closeness"))
