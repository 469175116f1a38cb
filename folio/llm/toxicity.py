"""Toxicity by a classifier that is regularised with counterfactuals.

A text is the set of its hashed words and word beginnings. A sparse logistic
regression (FTRL-proximal: L1 and L2) is trained in numpy on a bounded sample of
labelled rows. Each labelled sentence is also seen with its identity terms swapped
for others, or, if it has none, with terms put into it; the square of the score's
change is penalised, so a group's name by itself doesn't move the score. The least
score to flag is the one of best F1 on held-out rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import _MIX, folded, mix, pieces, words

#: Most labelled rows that the classifier is fitted on (those of least hashed id).
SAMPLE = 8000
#: Buckets of features (log2) and the lengths in bytes of the word beginnings.
BITS, BEGINNINGS = 18, (4, 5, 6, 7, 8)
#: Weights of the L1 and L2 penalties and of the counterfactual one.
L1, L2, FAIR = 8.0, 1.0, 4.0

#: Names of groups; single words, lower case.
IDENTITY = tuple(
    "women men woman man girls boys gay lesbian transgender straight black white asian african european latino muslim muslims christian christians jewish jews "
    "hindu buddhist atheist immigrant immigrants refugee refugees foreigner disabled deaf blind elderly young "
    "femmes hommes musulmans juifs noirs arabes immigrés handicapés frauen männer muslime juden ausländer behinderte mujeres hombres musulmanes judíos negros inmigrantes".split()
)


@dataclass
class Model:
    """Weights of the buckets, bias and least score."""

    weights: np.ndarray
    bias: float
    least: float = 0.5

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of each text; only features with a weight are looked at twice."""
        out = np.zeros(len(column))
        for i, j, data, bounds in pieces(column):
            found, owner = features(data, bounds, self.weights)
            code = np.unique(owner * np.int64(len(self.weights)) + found)
            doc, bucket = code // len(self.weights), code % len(self.weights)
            out[i:j] = np.bincount(doc, self.weights[bucket], minlength=j - i)[: j - i]
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def features(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and word beginning; with `weights`, of those that have one."""
    hashes, starts, ends, first = words(data, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    found, whose = [], []

    def add(codes: np.ndarray, at: np.ndarray) -> None:
        bucket = (codes >> shift).astype(np.int64)
        if weights is not None:
            some = weights[bucket] != 0
            bucket, at = bucket[some], at[some]
        found.append(bucket)
        whose.append(at)

    add(mix(hashes), owner)
    if len(data):
        low = folded(data).astype(np.uint64) + np.uint64(1)
        code, done = np.zeros(len(starts), np.uint64), 0
        at = np.arange(len(starts))
        for size in BEGINNINGS:
            long = ends[at] - starts[at] > size
            at, code = at[long], code[long]
            for k in range(done, size):
                code = code * _MIX[9] + low[starts[at] + k]
            done = size
            add(mix(code + np.uint64(size)), owner[at])
    return np.concatenate(found), np.concatenate(whose)


def _buckets(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(features(data, np.array([0, len(data)]))[0])


def swapped(sentence: str, rng: np.random.Generator, identity: tuple[str, ...] = IDENTITY) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The identity terms of a sentence and those put in their place.

    A sentence without any is taken with a random term put into it, and that one swapped.
    """
    known = set(identity)
    there = tuple(sorted({w for w in (x.strip(".,;:!?\"'()") for x in sentence.lower().split()) if w in known}))
    one, two = (identity[int(k)] for k in rng.choice(len(identity), 2, replace=len(identity) < 2))
    if not there:
        return (one,), (two,)
    return there, tuple(sorted({one if w != one else two for w in there}))


def fit(texts: list[str], labels: list[int], identity: tuple[str, ...] = IDENTITY, fair: float = FAIR, epochs: int = 3, seed: int = 11) -> Model | None:
    """Train on four fifths, choose the least score on the rest; None unless both labels occur."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    rate, bias, seen = 0.3, 0.0, 1.0
    cases = [(_buckets(t), y, k % 5 == 0, k) for k, (t, y) in enumerate(zip(texts, labels))]
    share, known = max(1e-3, np.mean(labels)), set(identity)

    def weight(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((1 + np.sqrt(n[ids])) / rate + L2))

    def update(ids: np.ndarray, now: np.ndarray, slope: float) -> None:
        step = (np.sqrt(n[ids] + slope * slope) - np.sqrt(n[ids])) / rate
        z[ids] += slope - step * now
        n[ids] += slope * slope

    @lru_cache(maxsize=1 << 12)
    def of(terms: tuple[str, ...]) -> np.ndarray:
        return _buckets(" ".join(terms))

    def pull(sentence: str) -> None:
        """A step against the change of score: the score being linear, only swapped words change it."""
        out, into = map(of, swapped(sentence, rng, identity))
        a, b = np.setdiff1d(out, into), np.setdiff1d(into, out)
        gap = weight(a).sum() - weight(b).sum()
        if gap:
            step = float(np.clip(fair * gap, -4, 4))
            update(a, weight(a), step)
            update(b, weight(b), -step)

    for _ in range(epochs):
        for e in rng.permutation(len(cases)):
            ids, y, held, k = cases[e]
            if held:
                continue
            now = weight(ids)
            p = 1 / (1 + np.exp(-np.clip(now.sum() + bias, -30, 30)))
            slope = (p - y) * (1.0 if not y else min(4.0, 0.5 / share))
            update(ids, now, slope)
            seen += slope * slope
            bias -= 0.3 * slope / np.sqrt(seen)
            if fair and identity:
                sentences = [s for s in texts[k].replace("\n", ". ").split(". ") if s]
                if sentences:
                    for sentence in [s for s in sentences if known.intersection(s.lower().split())] or [sentences[int(rng.integers(len(sentences)))]]:
                        pull(sentence)
    model = Model(weight(np.arange(size)).astype(np.float32), float(bias))
    held = [k for _, _, h, k in cases if h and labels[k] in (0, 1)]
    score, truth = model.scores(pa.array([texts[k] for k in held], pa.string())), np.array([labels[k] for k in held])
    best = (0.0, 0.5)
    for least in np.unique(np.round(np.append(score, 0.5), 3)):
        flagged = score >= least
        f1 = 2 * (flagged & (truth == 1)).sum() / max(1, flagged.sum() + truth.sum())
        best = max(best, (float(f1), -abs(float(least) - 0.5)))
        if best == (float(f1), -abs(float(least) - 0.5)):
            model.least = float(least)
    return model


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from the `sample` labelled rows of least hashed id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if chosen.empty:
        return None
    small = docs.sparkSession.createDataFrame(chosen)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(small), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["_toxic"]) for r in rows])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) of every row, labelled or not.

    A null text has a null score and isn't toxic; an empty one has the score of no features.
    Without labelled rows of both kinds every score is null. Rows that repeat an id are scored
    each for itself; of labels that repeat an id the toxic one counts. Other columns are dropped.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            score = model.value.scores(batch.column(1)) if model.value else np.zeros(len(null))
            null = null | (model.value is None)
            toxic = ~null & (score >= (model.value.least if model.value else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 4), mask=null), pa.array(toxic)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, toxic boolean")


def flagged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of the rows that `scored` finds toxic."""
    return scored(docs, labels, sample).where("toxic").select("doc_id", "score")
