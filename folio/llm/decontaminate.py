"""Benchmark decontamination by a prefix-filtered set join.

An item is the set of its word n-grams (shingles). A document contains it if
some window of the document as long as the item holds at least `threshold` of
that set. Shingles are ordered by rarity: the number of documents of the whole
corpus that hold them. A window that reaches the threshold holds one of the
item's rarest |S| - need + 1 shingles, so only those are looked up. A document
with fewer shingles than needed is left out (length), and only what lies within
an item's length of such a hit is counted (position). Windows that start at a
shingle of the item are then counted exactly.

The benchmark is the side that is sent to the executors, in groups of bounded
size: a larger benchmark takes more passes over the documents, each as small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.llm.common import by_ids, local, stored
from folio.llm.words import SQL_WORDS, ngrams, owners, pieces, words

#: Words of a shingle; share of an item's shingles that a window must hold.
WORDS, THRESHOLD = 3, 0.6
#: Shingles of the items that are sent to the executors at once.
GROUP = 1 << 20


class Index:
    """The shingles of a group of items, and after `order` their prefixes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.keys = np.unique(np.concatenate([g for _, g in items])) if items else np.empty(0, np.uint64)
        self.spans = [len(g) for _, g in items]
        self.sets = [np.searchsorted(self.keys, np.unique(g)) for _, g in items]
        self.needs = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.maybe = self._table(self.keys)

    @staticmethod
    def _table(keys: np.ndarray) -> tuple[int, np.ndarray]:
        bits = min(25, max(16, (16 * len(keys)).bit_length()))
        table = np.zeros(1 << bits, bool)
        table[keys >> np.uint64(64 - bits)] = True
        return bits, table

    def order(self, counts: np.ndarray) -> None:
        """Keep each item's rarest shingles as those to look up; ties by hash."""
        pairs = []
        for i, (s, need) in enumerate(zip(self.sets, self.needs)):
            rare = s[np.lexsort((self.keys[s], counts[s]))][: len(s) - need + 1]
            pairs.append(np.stack([rare, np.full(len(rare), i)]))
        at = np.concatenate(pairs, axis=1)
        at = at[:, np.argsort(at[0], kind="stable")]
        self.items = at[1]
        self.first = np.searchsorted(at[0], np.arange(len(self.keys) + 1))

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the grams that the items have, and their places in `keys`."""
        bits, table = self.maybe
        at = np.flatnonzero(table[grams >> np.uint64(64 - bits)])
        place = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[place] == grams[at]
        return at[same], place[same]

    def best(self, item: int, at: np.ndarray, keys: np.ndarray, near: np.ndarray) -> int:
        """Most distinct shingles of the item in one window, or 0 if too few."""
        own, span, need = self.sets[item], self.spans[item], self.needs[item]
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        mine = own[place] == keys
        at, keys = at[mine], keys[mine]
        hit = np.minimum(np.searchsorted(near, at), len(near) - 1)
        gap = np.minimum(np.abs(near[hit] - at), np.abs(near[np.maximum(hit - 1, 0)] - at))
        at, keys = at[gap < span], keys[gap < span]
        if len(np.unique(keys)) < need:
            return 0
        most, left, inside = 0, 0, {}
        p, k = at.tolist(), keys.tolist()
        for right in range(len(p)):
            inside[k[right]] = inside.get(k[right], 0) + 1
            while p[right] - p[left] >= span:
                inside[k[left]] -= 1
                if not inside[k[left]]:
                    del inside[k[left]]
                left += 1
            most = max(most, len(inside))
        return most if most >= need else 0


def _grams(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, _, data, bounds in pieces(column):
        hashes, _, _, first = words(data, bounds)
        yield i, *ngrams(hashes, first, n)


def _groups(benchmark: DataFrame, n: int, threshold: float, group: int) -> Iterator[Index]:
    """The items in groups of bounded size; an item of fewer than `n` words is in none."""
    items: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        for _, grams, _ in _grams(pa.array([row["text"]], pa.string()), n):
            if len(grams):
                items.append((row["item_id"], grams))
                size += len(grams)
        if size >= group:
            yield Index(items, threshold)
            items, size = [], 0
    if items:
        yield Index(items, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, item_id, shared, containment) of every item that a document contains.

    `shared` is the most distinct shingles of the item in one window of its length.
    Null ids and texts, texts and items of fewer than `n` words, and empty tables
    give no row; of rows that repeat an id the best counts. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = local(spark, StructType.fromDDL("doc_id long, item_id long, shared long, containment double"), [], [], [], [])
    for index in _groups(benchmark, n, threshold, group):
        rows = rows.unionByName(_leaks(texts, index, n))
    return rows.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.round(F.max("containment"), 4).alias("containment"))


def _leaks(texts: DataFrame, index: Index, n: int) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        total = np.zeros(len(index.keys), np.int64)
        for batch in batches:
            for _, grams, first in _grams(batch.column(0), n):
                at, key = index.found(grams)
                doc = np.searchsorted(first, at, "right")
                total += np.bincount(np.unique(doc * len(total) + key) % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    counts = np.zeros(len(index.keys), np.int64)
    found = texts.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts[found["key"].to_numpy()] = found["n"].to_numpy()
    index.order(counts)
    ordered = sc.broadcast(index)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ordered.value
        for batch in batches:
            ids, out = batch.column(0), []
            for row, grams, first in _grams(batch.column(1), n):
                at, key = index.found(grams)
                posts = index.first[key + 1] - index.first[key]
                if not posts.any():
                    continue
                where = np.repeat(np.arange(len(at)), posts)
                item = index.items[np.arange(len(where)) - np.repeat(np.cumsum(posts) - posts, posts) + np.repeat(index.first[key], posts)]
                doc = np.searchsorted(first, at[where], "right") - 1
                pairs = np.lexsort((where, item, doc))
                cuts = np.flatnonzero(np.diff(doc[pairs]) | np.diff(item[pairs])) + 1
                for run in np.split(pairs, cuts):
                    d, i = int(doc[run[0]]), int(item[run[0]])
                    if first[d + 1] - first[d] < index.needs[i]:
                        continue
                    lo, hi = np.searchsorted(at, first[d]), np.searchsorted(at, first[d + 1])
                    if most := index.best(i, at[lo:hi], key[lo:hi], at[where[run]]):
                        out.append((ids[row + d].as_py(), int(index.ids[i]), most, most / len(index.sets[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "shared", "containment"])

    return texts.mapInArrow(match, "doc_id long, item_id long, shared long, containment double")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those that contain an item; null ids and texts stay."""
    ids = stored(leaks(docs, benchmark, n, threshold).select("doc_id").distinct(), "leaks")
    return by_ids(docs, ids, "doc_id", "left_anti")


def sql(n: int = WORDS, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of `leaks` over `documents` and `benchmark`, for unique ids."""
    gram = " || ' ' || ".join(f"w[p + {k}]" for k in range(n))

    def shingles(table: str, key: str) -> str:
        return (
            f"SELECT {key}, p, {gram} AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n} + 2)) AS p FROM "
            f"(SELECT {key}, {SQL_WORDS} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL) WHERE len(w) >= {n})"
        )

    return f"""
WITH d AS ({shingles("documents", "doc_id")}), i AS ({shingles("benchmark", "item_id")}),
s AS (SELECT item_id, count(*) AS span, count(DISTINCT g) AS size FROM i GROUP BY item_id),
h AS (SELECT d.doc_id, u.item_id, d.p, d.g, s.span, s.size FROM d JOIN (SELECT DISTINCT item_id, g FROM i) u USING (g) JOIN s USING (item_id)),
v AS (SELECT a.doc_id, a.item_id, a.p, a.size, count(DISTINCT b.g) AS shared
      FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.span - 1 GROUP BY ALL)
SELECT doc_id, item_id, max(shared) AS shared, round(max(shared / size), 4) AS containment
FROM v WHERE shared >= ceil({threshold} * size - 1e-9) GROUP BY doc_id, item_id
"""
