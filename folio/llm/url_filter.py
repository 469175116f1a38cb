"""URL filter: logistic regression on hashed character n-grams of host and path.

Host and path are cut from the URL, lower-cased and bordered; their n-grams are
hashed to separate halves of one table. The model is trained in numpy from a small
table of labelled URLs, which is a parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets (half for hosts, half for paths), sizes of n-grams, least probability to block.
BUCKETS, SIZES, THRESHOLD = 1 << 14, (3, 4, 5), 0.5

#: Most labelled URLs that the model is fitted on (those of least hashed URL).
SAMPLE = 10_000


def labelled_urls() -> list[tuple[str, int]]:
    """The module's own table: 400 invented URLs of many kinds, half of them unwanted (1).

    They are made of words for gambling, drugs, advertising, phishing, spam, malware, loans, fakes and adult
    pages on one side, and for institutions, trades, sciences and pastimes on the other.
    """
    lines = resources.files("folio.llm").joinpath("url_labels.tsv").read_text().splitlines()
    return [(u, int(y)) for u, y in (x.split("\t") for x in lines)]


def parts(url: str) -> tuple[str, str]:
    """Host (without port and user) and path with query, lower case."""
    rest = url.strip().lower()
    rest = rest.split("://", 1)[1] if "://" in rest else rest.removeprefix("//")
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    return rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0], rest[cut:].split("#", 1)[0]


def buckets(url: str) -> np.ndarray:
    """The buckets of a URL's n-grams, each once."""
    half, found = BUCKETS // 2, set()
    for k, text in enumerate(parts(url)):
        raw = f"^{text}$".encode()
        found |= {k * half + zlib.crc32(raw[i : i + n]) % half for n in SIZES for i in range(len(raw) - n + 1)}
    return np.fromiter(sorted(found), np.int64, len(found))


def fit(labelled: list[tuple[str, int]], steps: int = 600, rate: float = 10.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent; each URL's n-grams share a unit length. Both labels must occur."""
    cases = [(buckets(u), y) for u, y in labelled if u]
    sizes = np.array([len(ids) for ids, _ in cases])
    ids, truth = np.concatenate([x for x, _ in cases]), np.array([y for _, y in cases], float)
    owner, share = np.repeat(np.arange(len(cases)), sizes), np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        score = bias + np.bincount(owner, weights[ids] * share, len(cases))
        error = (1 / (1 + np.exp(-score)) - truth) / len(cases)
        weights -= rate * (decay * weights + np.bincount(ids, error[owner] * share, BUCKETS))
        bias -= rate * error.sum()
    return weights, bias


def _score(weights: np.ndarray, bias: float, ids: np.ndarray) -> float:
    return bias + weights[ids].sum() / np.sqrt(max(1, len(ids)))


def judged(pages: DataFrame, labelled: DataFrame | list[tuple[str, int]] | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, score, blocked) of every row; score is the probability to be unwanted.

    `labelled` has the columns url and unwanted (0 or 1); rows with a null count for nothing, up to `sample`
    are used. Without URLs of both labels every score is null and nothing is blocked. A null URL has a
    null score and isn't blocked; the empty one has no n-grams but the borders', a long one is read whole. Rows that
    repeat an id, or have none, are judged each for itself; an empty table gives no row; other
    columns, whatever their names, are dropped.
    """
    if labelled is None:
        labelled = labelled_urls()
    elif isinstance(labelled, DataFrame):
        known = labelled.where("url IS NOT NULL AND unwanted IN (0, 1)").select("url", "unwanted")
        labelled = [(r["url"], int(r["unwanted"])) for r in known.orderBy(F.xxhash64("url"), "url", "unwanted").limit(sample).collect()]
    both = len({y for u, y in labelled if u}) == 2
    weights, bias = fit(labelled) if both else (np.zeros(BUCKETS), 0.0)
    model = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            score = [None if u is None or not both else round(float(1 / (1 + np.exp(-_score(weights, bias, buckets(u))))), 6) for u in batch.column(1).to_pylist()]
            blocked = [s is not None and s >= threshold for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(blocked, pa.bool_())], ["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, url string, score double, blocked boolean")
