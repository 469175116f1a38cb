"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are byte n-grams within a word, its borders included. A text's vector is
the mean of its subwords' embeddings, and a linear layer with softmax gives the
languages' probabilities. Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature and two bounds
are calibrated on held-out rows, whole texts and random passages of them alike: the
confidence below which a text is rejected, so that errors among accepted texts keep to
`ERRORS`, and the share of subwords unknown from training clearly above which
it is, as texts in none of the languages have.

Scoring multiplies the embeddings by the layer once: the mean of those products
is the same logits, at one table lookup a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import local
from folio.llm.words import _MIX, folded, pieces

#: Most labelled rows that the model is fitted on (those of least hashed id).
SAMPLE = 3000
#: Buckets of subwords (a power of two), width of the embeddings, sizes of subwords in bytes.
BUCKETS, WIDTH, SIZES = 1 << 15, 16, (2, 3, 4)
#: Share of errors among accepted held-out texts that sets the least confidence; share of held-out
#: texts that may be rejected for subwords that training never met.
ERRORS, STRANGERS = 0.01, 0.001
#: Bytes of texts scored together; each takes some hundred bytes meanwhile.
AT_ONCE = 1 << 18

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Model:
    """Languages, logits of the buckets, bias, temperature, least confidence; unknown buckets (1) and the most of them."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    unknown: np.ndarray | None = None
    most: float = 1.0


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and the text of each."""
    n = len(bounds) - 1
    low = folded(data) if len(data) else data
    at = np.arange(len(low)) + np.repeat(np.arange(n), np.diff(bounds)) + 1
    text = np.full(len(low) + n + 1, 32, np.uint8)
    text[at] = np.where(_LETTER[low], low, 32)
    gap = text == 32
    ends = bounds[1:] + np.arange(1, n + 1)  # the space after each text
    wide = text.astype(np.uint32)
    found, where = [], []
    for size in SIZES:
        count = len(text) - size + 1
        if count <= 0:
            continue
        code = np.zeros(count, np.uint32)
        inner = np.zeros(count, bool)
        for k in range(size):
            code = code * np.uint32(0x01000193) + wide[k : k + count]
            if 0 < k < size - 1:
                inner |= gap[k : k + count]
        if size == 2:
            inner = gap[:count] & gap[1 : count + 1]
        keep = np.flatnonzero(~inner)
        code = code[keep] * np.uint32(int(_MIX[size]) & 0xFFFFFFFF | 1)
        code ^= code >> np.uint32(15)
        found.append((code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        where.append(np.searchsorted(ends, keep, "right"))
    return np.concatenate(found), np.concatenate(where)


def logits(model: Model, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, mean logits of each text, its subwords, the share of unknown ones) of runs of rows."""
    for i, j, data, bounds in pieces(column, AT_ONCE):
        bucket, where = subwords(data, bounds)
        number = np.bincount(where, minlength=j - i)
        total = np.stack([np.bincount(where, model.logits[bucket, k], minlength=j - i) for k in range(len(model.languages))], 1)
        strange = np.zeros(j - i) if model.unknown is None else np.bincount(where, model.unknown[bucket], minlength=j - i)
        yield i, total / np.maximum(number, 1)[:, None] + model.bias, number, strange / np.maximum(number, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model | None:
    """Train and calibrate; None without labelled text. One fifth is held out."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    examples: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    for k, (text, label) in enumerate(zip(texts, labels)):
        data = np.frombuffer(text.encode(), np.uint8)
        spans = [(0, len(data))] + [(int(s), int(s) + int(rng.integers(16, 200))) for s in rng.integers(0, max(1, len(data) - 16), 3)]
        for a, b in spans:
            part = data[a:b]
            bucket, _ = subwords(part, np.array([0, len(part)]))
            if len(bucket):
                ids, counts = np.unique(bucket, return_counts=True)
                examples.append((ids, (counts / counts.sum()).astype(np.float32), languages.index(label), k % 5 == 0))
    if not examples:
        return None
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.5, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    train = [x for x in examples if not x[3]] or examples
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for e in rng.permutation(len(train)):
            ids, share, label, _ = train[e]
            pace = rate * (1 - step / steps)
            vector = share @ table[ids]
            error = _softmax(vector @ layer + bias)
            error[label] -= 1
            back = layer @ error
            layer -= pace * np.outer(vector, error)
            bias -= pace * 0.1 * error
            table[ids] -= (pace * 20 * share)[:, None] * back
            step += 1
    model = Model(languages, np.ascontiguousarray(table @ layer), bias)
    held = [x for x in examples if x[3]] or examples
    scores = np.array([x[1] @ model.logits[x[0]] + bias for x in held])
    truth = np.array([x[2] for x in held])
    heats = np.geomspace(0.2, 20, 60)
    loss = [-np.log(_softmax(scores / h)[np.arange(len(truth)), truth] + 1e-12).mean() for h in heats]
    model.temperature = float(heats[int(np.argmin(loss))])
    chance = _softmax(scores / model.temperature)
    sure, wrong = chance.max(1), chance.argmax(1) != truth
    model.least = _least(sure, wrong)
    model.unknown = np.ones(BUCKETS, np.float32)
    for ids, *_ in train:
        model.unknown[ids] = 0
    strange = np.array([x[1] @ model.unknown[x[0]] for x in held])
    model.most = float(np.quantile(strange, 1 - STRANGERS, method="higher")) if held is not examples else 1.0
    return model


def _least(sure: np.ndarray, wrong: np.ndarray) -> float:
    """The lowest confidence above which no more are wrong than `ERRORS` and two standard errors of a sample's share explain; 0 if all may be accepted."""
    number = np.arange(1, len(wrong) + 1)
    order = np.argsort(-sure)
    good = np.flatnonzero(np.cumsum(wrong[order]) <= ERRORS * number + 2 * np.sqrt(ERRORS * (1 - ERRORS) * number))
    if len(good) == 0:
        return 0.0 if len(wrong) == 0 else 1.0
    return 0.0 if good[-1] == len(wrong) - 1 else float(sure[order][good[-1]])


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model fitted on the `sample` labelled rows of least hashed id."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    ids = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return None
    chosen = local(docs.sparkSession, docs.select("doc_id").schema, ids)
    found = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "lang").orderBy("doc_id", F.xxhash64("text"), "lang").limit(sample).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def _judged(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (-1: none), confidence and rejection of each text."""
    best, sure, strange = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column))
    if model is None:
        return best, sure, np.zeros(len(column), bool)
    for i, scores, number, share in logits(model, column):
        chance = _softmax(scores / model.temperature)
        some = number > 0
        best[i : i + len(number)] = np.where(some, chance.argmax(1), -1)
        sure[i : i + len(number)] = np.where(some, chance.max(1), 0)
        strange[i : i + len(number)] = share - 1 / np.sqrt(np.maximum(number, 1))  # less two standard errors of a share
    return best, sure, (best < 0) | (sure < model.least) | (strange > model.most)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, predicted, confidence, rejected) of every row.

    Texts without letters, empty and null ones have no predicted language, confidence 0,
    and are rejected; so is a text below the calibrated confidence or with too many subwords
    unknown from training, which keeps its best guess (ties: the first of the languages by name). Without any labelled row nothing is predicted and nothing rejected.
    Rows that repeat an id, or have none, are judged each for itself.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure, rejected = _judged(model.value, batch.column(1))
            names = model.value.languages if model.value else []
            predicted = pa.array([names[b] if b >= 0 else None for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), predicted, pa.array(np.round(sure, 4)), pa.array(rejected)], ["doc_id", "predicted", "confidence", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, predicted string, confidence double, rejected boolean")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that `identify` doesn't reject, with their columns, whatever their names.

    So null texts, empty ones and those without letters go; rows that repeat an id, or have none,
    are judged each for itself; without labelled rows, or any rows, all stay. Rows need the columns doc_id, text and lang.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, sample))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = _judged(model.value, batch.column(place))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
