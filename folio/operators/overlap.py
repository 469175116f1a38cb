"""N-gram overlap with a protected corpus, vector search and the similarity gate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text

N = 8


def index(corpus: DataFrame, n: int = N) -> DataFrame:
    """The distinct n-grams of a corpus (gram)."""
    words = corpus.select(text.tokens(F.col("text")).alias("w"))
    return words.select(F.explode(text.ngrams(F.col("w"), n)).alias("gram")).distinct()


def _short(corpus: DataFrame, n: int) -> DataFrame:
    """Distinct (k, gram) for k up to n of the texts that have n tokens."""
    words = corpus.select(text.tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    return reduce(DataFrame.unionByName, [words.select(F.lit(k).alias("k"), F.explode(text.ngrams(F.col("w"), k)).alias("gram")) for k in range(1, n + 1)]).distinct()


def longest_match(candidates: DataFrame, corpus: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, max_match): the longest run of up to n tokens that the corpus has too, else 0."""
    words = candidates.select("doc_id", text.tokens(F.col("text")).alias("w"))
    grams = reduce(DataFrame.unionByName, [words.select("doc_id", F.lit(k).alias("k"), F.explode(text.ngrams(F.col("w"), k)).alias("gram")) for k in range(1, n + 1)])
    hits = grams.join(_short(corpus, n), ["k", "gram"], "left_semi").groupBy("doc_id").agg(F.max("k").alias("max_match"))
    return candidates.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("max_match", F.lit(0)).alias("max_match"))


def overlap(candidates: DataFrame, corpus: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, grams, matching, overlap_ratio): share of a text's distinct n-grams that the corpus has."""
    words = candidates.select("doc_id", text.tokens(F.col("text")).alias("w"))
    distinct = F.array_distinct(text.ngrams(F.col("w"), n))
    # exploded in place: a filter inferred from an exploded column would tokenise anew for every gram
    hits = words.select("doc_id", F.explode(distinct).alias("gram")).join(index(corpus, n), "gram", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matching"))
    rows = words.select("doc_id", F.size(distinct).cast("long").alias("grams")).join(hits, "doc_id", "left")
    matching = F.coalesce("matching", F.lit(0))
    return rows.select("doc_id", "grams", matching.alias("matching"), F.when(F.col("grams") > 0, F.round(matching / F.col("grams"), 6)).otherwise(0.0).alias("overlap_ratio"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(ids, vectors): about `size` vectors a row, by hash of the id."""
    number = max(1, -(-vectors.count() // size))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(number)).alias("_b"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("v")).select(F.col("v.vec_id").alias("ids"), F.flatten("v.e").alias("numbers"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact inner products, ties by the lesser id; a vector isn't its own hit.

    Every block of queries meets every block of vectors in one matrix product, which leaves
    k hits for each query; those are merged. Null vectors are no hits; all have one length.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, numbers, other, others = (np.asarray(batch.column(c)[row].values) for c in range(4))
                left, right = numbers.reshape(len(ids), -1), others.reshape(len(other), -1).T
                for at in range(0, len(ids), rows):
                    own, best, found = ids[at : at + rows], None, []
                    for start in range(0, len(other), part):  # a product of some rows and columns stays in the cache
                        names = other[start : start + part]
                        score = left[at : at + rows] @ right[:, start : start + part]
                        low, high = np.searchsorted(names, own), np.searchsorted(names, own, "right")
                        for i in np.flatnonzero(high > low):
                            score[i, low[i] : high[i]] = -np.inf
                        if best is None:
                            if np.isnan(score.sum()):
                                score[np.isnan(score)] = -np.inf
                            n = min(k, score.shape[1])
                            best = np.full((len(own), k), -np.inf)
                            best[:, :n] = -np.partition(-score, n - 1, axis=1)[:, :n]
                        # rounding moves a score by half a step at most: what may be among the best k
                        flat = np.flatnonzero(score >= (best.min(axis=1) - 1.1e-5)[:, None])
                        who, where = np.divmod(flat, score.shape[1])
                        value = score.ravel()[flat]
                        some = np.isfinite(value)
                        who, where, value = who[some], where[some], value[some]
                        found.append((who, names[where], np.round(value, 5)))
                        if start:
                            both, owner = np.concatenate([best.ravel(), value]), np.concatenate([np.repeat(np.arange(len(own)), k), who])
                            order = np.lexsort((-both, owner))
                            first = np.searchsorted(owner[order], np.arange(len(own)))
                            best = both[order][first[:, None] + np.arange(k)]
                    who, hit, value = (np.concatenate(x) for x in zip(*found))
                    order = np.lexsort((hit, -value, who))
                    who, hit, value = who[order], hit[order], value[order]
                    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
                    yield pa.RecordBatch.from_arrays([pa.array(own[who[kept]]), pa.array(hit[kept]), pa.array(value[kept])], ["query_id", "vec_id", "similarity"])

    rows, part = 64, max(1, block // 2)
    one = _blocks(queries, block).repartition(64)
    two = _blocks(vectors, 4 * block).select(F.col("ids").alias("other"), F.col("numbers").alias("others"))
    hits = one.crossJoin(two).mapInArrow(match, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def gate(match: DataFrame, most: int = 12, similar: float = 0.88) -> DataFrame:
    """`fallback` and its `reason` from max_match and top1; the similarity rounds as the number itself, not as its shortest digits (0.565 to 0.56)."""
    runs, near = F.col("max_match") >= most, F.col("top1") >= similar
    reason = F.concat_ws("; ", F.when(runs, F.format_string("ngram match %d", "max_match")), F.when(near, F.concat(F.lit("embedding similarity "), F.call_function("format_number", F.col("top1"), F.lit("0.00")))))
    return match.withColumn("fallback", F.coalesce(runs, F.lit(False)) | F.coalesce(near, F.lit(False))).withColumn("reason", reason)
