"""Maximal repeats by the common-prefix interval tree of an enhanced suffix array.

Texts are sequences of words (runs between white space). A repeat of at least
`least` words is maximal if its occurrences can't all be extended by one word, to
the left or to the right. Sorted suffixes with the lengths of their common prefixes
form a tree of intervals; a stack scan yields each interval with its length, which
is maximal to the right; it is maximal to the left if the words before its suffixes
differ, or one has none before. All suffixes of the interval are its occurrences:
the result is the suffixes in their order, and the intervals over them.

Only suffixes that can start a maximal repeat are sorted, and only with those they
can share a prefix with. Three exact steps lead there:

1. From every `least` words the least-hashed run of `ANCHOR` words is an anchor.
   Equal passages have equal anchors, so passages around anchors that occur once
   are left out.
2. Of what is left, every place is grouped by its next `least` words. Groups of
   one, and groups that the same word precedes everywhere, are left out.
3. The suffixes of the places left, as far as step 1 reaches, meet by the anchor
   of their first words; each such set is one part of the suffix array.

Words are compared as hashes: 64 bits in step 2, 48 in the suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import buckets_of, by_ids, stored
from folio.llm.words import SPACE, _powers, mix, ngrams, pieces, words

#: Words of the shortest repeat, and of an anchor.
LEAST, ANCHOR = 50, 16
#: Places a task holds before it sends them; occurrences in a batch of results.
FLUSH, BATCH = 1 << 21, 1 << 17
#: Bytes of suffixes that are sorted as copies; beyond, by ranks, if their texts are much smaller.
COPIED = 1 << 24
#: Stands for the word before a text's first.
START = 0

_NAMES = ["bucket", "ids", "counts", "hashes", "lefts", "places"]
ROWS = "repeat_id long, n_words long, occurrences long, place long, doc_id long, start long, longer array<struct<n_words: long, occurrences: long>>"
_PLACES = "bucket int, ids binary, counts binary, hashes binary, lefts binary, places binary"


def _window(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least (or greatest) element of every `size` in a row."""
    pick, span = (np.minimum if least else np.maximum), 1
    if len(x) < size:
        return x[:0]
    while span * 2 <= size:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (size - span)], x[size - span :]) if span < size else x


def _anchors(hashes: np.ndarray, first: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `anchor` words, each text's first, and the least of each window (0: crosses texts)."""
    runs, begin = ngrams(hashes, first, anchor)
    runs |= np.uint64(1)  # 0 is no hash
    width = least - anchor + 1
    low = _window(runs, width, True)
    if len(low):
        inside = np.zeros(len(low) + 1, np.int64)
        counts = np.maximum(np.diff(begin) - width + 1, 0)
        some = counts > 0
        np.add.at(inside, begin[:-1][some], 1)
        np.add.at(inside, (begin[:-1] + counts)[some], -1)
        low = np.where(np.cumsum(inside[:-1]) > 0, low, np.uint64(0))
    return runs, begin, low


def _chosen(runs: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The runs that are the least of some window."""
    if not len(low):
        return np.empty(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_window(np.concatenate([edge, low, edge]), width, False) == runs)


class _Places:
    """Collects (text, hash, left, place) and packs them by bucket of the hash."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.number = buckets, [], 0

    def add(self, ids: list[int], owner: np.ndarray, hashes: np.ndarray, lefts: np.ndarray, places: np.ndarray) -> None:
        self.held.append((np.array(ids, np.int64), owner, hashes, lefts, places))
        self.number += len(hashes)

    def packed(self) -> pa.RecordBatch:
        base = np.cumsum([0, *(len(h[0]) for h in self.held)])
        ids, hashes, lefts, places = (np.concatenate([h[k] for h in self.held]) for k in (0, 2, 3, 4))
        owner = np.concatenate([h[1] + b for h, b in zip(self.held, base)])
        bucket = (mix(hashes) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[b] : cuts[b + 1]]
            cut = np.flatnonzero(np.diff(owner[at], prepend=-1))
            rows.append((int(b), *(x.tobytes() for x in (ids[owner[at][cut]], np.diff(np.append(cut, len(at))).astype(np.uint32), hashes[at], lefts[at].astype(np.uint32), places[at].astype(np.uint32)))))
        self.held, self.number = [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], _NAMES)


def _kept(diverse: bool):
    """(doc_id, places) of hashes that occur twice, and if `diverse` with different words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.repeat(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.uint32))
                parts.append((ids, np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["lefts"], np.uint32), np.frombuffer(row["places"], np.uint32)))
        if not parts:
            return
        ids, hashes, lefts, places = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        good = np.diff(np.append(starts, len(order))) > 1
        if diverse:
            left = lefts[order]
            low, high = np.minimum.reduceat(left, starts), np.maximum.reduceat(left, starts)
            good &= (low != high) | (low == START)
        order = order[good[group]]
        ids, places = ids[order], places[order]
        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
        for k in range(0, len(cut), 1 << 14):
            ends = np.append(cut, len(ids))[k : k + (1 << 14) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]]), pa.array([places[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["doc_id", "places"])

    return run


def _spots(rows: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows])).astype(np.int64)


def _reach(spots: np.ndarray, count: int, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a repeat may start, and for every place where the passage around it ends."""
    room = count - least + 1
    cover = np.zeros(count + 2, np.int64)
    low, high = np.maximum(spots - width + 1, 0), np.minimum(spots, room - 1)
    some = (high >= low) & (spots < count)
    np.add.at(cover, low[some], 1)
    np.add.at(cover, high[some] + 1, -1)
    places = np.flatnonzero(np.cumsum(cover)[: max(room, 0)] > 0)
    end = np.zeros(count + 2, np.int64)
    np.add.at(end, low[some], 1)
    np.add.at(end, np.minimum(spots[some] + least, count), -1)
    inside = np.cumsum(end)[:count] > 0
    stops = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    return places, stops


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, _, data, bounds in pieces(batch.column(column)):
        hashes, _, _, first = words(data, bounds, SPACE, fold=False)
        yield row, hashes, first


def maximal(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """All maximal repeats with all their occurrences: (repeat_id, n_words, occurrences, place, doc_id, start, longer).

    Repeats that share their first `least` words lie within one outermost repeat, so each
    place where any repeat starts has one row: its document, the word (from 0) it starts at, the
    id, words and occurrences of the outermost repeat, and its place among that one's
    suffixes in their order. `longer` lists the repeats within it whose first suffix is
    this one: such a repeat of k occurrences has those of this row and the k - 1 after it.
    So the rows grow with the places, and not with the lists of nested repeats;
    `occurrences` makes those lists of them.

    A repeat within one document counts. Null ids, null texts and texts of fewer
    than `least` words have no row; an empty table has none. Rows that repeat an id
    are texts of their own, whose occurrences carry the same id. Other columns, whatever their
    names, are not read.
    """
    anchor = min(anchor, least)
    width = least - anchor + 1
    buckets = buckets_of(docs)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Places(buckets)
        for batch in batches:
            for row, hashes, first in _texts(batch, 1):
                runs, begin, low = _anchors(hashes, first, least, anchor)
                at = _chosen(runs, low, width)
                owner = np.searchsorted(begin, at, "right") - 1
                ids = batch.column(0).slice(row, len(first) - 1).to_pylist()
                out.add(ids, owner, runs[at], np.zeros(len(at), np.uint32), at - begin[owner])
            if out.number >= FLUSH:
                yield out.packed()
        if out.number:
            yield out.packed()

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return stored(rows.groupBy("doc_id").agg(F.collect_list("places").alias(name)), name)

    def of(name: DataFrame) -> DataFrame:
        return by_ids(texts, stored(name.select("doc_id"), "ids"), "doc_id", "left_semi").join(name, "doc_id")

    spots = gathered(texts.mapInArrow(anchors, _PLACES).repartitionById(buckets, "bucket").mapInArrow(_kept(False), "doc_id long, places binary"), "spots")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Places(buckets)
        for batch in batches:
            for row, hashes, first in _texts(batch, 1):
                up, down = _powers(max(20, len(hashes).bit_length()))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
                cuts = first.tolist()
                for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at, _ = _reach(_spots(batch.column(2)[row + d].as_py()), b - a, least, width)
                    if len(at):
                        key = mix((sums[a + at + least] - sums[a + at]) * down[a + at])
                        left = (hashes[np.maximum(a + at - 1, 0)] >> np.uint64(32)) | np.uint64(1)
                        left[at == 0] = START
                        out.add([batch.column(0)[row + d].as_py()], np.zeros(len(at), np.int64), key, left.astype(np.uint32), at)
            if out.number >= FLUSH:
                yield out.packed()
        if out.number:
            yield out.packed()

    starts = gathered(of(spots).mapInArrow(places, _PLACES).repartitionById(buckets, "bucket").mapInArrow(_kept(True), "doc_id long, places binary"), "starts")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "doc_id", "starts", "lefts", "words"], [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row, hashes, first in _texts(batch, 1):
                _, begin, low = _anchors(hashes, first, least, anchor)
                raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
                cuts = first.tolist()
                for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at = _spots(batch.column(3)[row + d].as_py())
                    at = at[at + least <= b - a]  # another row of this id may be longer
                    if not len(at):
                        continue
                    _, stops = _reach(_spots(batch.column(2)[row + d].as_py()), b - a, least, width)
                    place = np.searchsorted(stops, at, "right")
                    at, place = at[place < len(stops)], place[place < len(stops)]
                    key = low[begin[d] + at]
                    lefts = hashes[np.maximum(a + at - 1, 0)] | np.uint64(1)
                    lefts[at == 0] = START
                    doc = batch.column(0)[row + d].as_py()
                    for run in np.split(np.arange(len(at)), np.flatnonzero((key[1:] != key[:-1]) | (place[1:] != place[:-1])) + 1):
                        if len(run):
                            whole = raw[a + at[run[0]] : a + stops[place[run[0]]]].tobytes()
                            rows.append((int(key[run[0]].view(np.int64)), doc, at[run].tobytes(), lefts[run].tobytes(), whole))
                            size += len(whole)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    joined = of(starts).join(spots, "doc_id").select("doc_id", "text", "spots", "starts")
    parts = joined.mapInArrow(suffixes, "key long, doc_id long, starts binary, lefts binary, words binary")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(least, COPIED), ROWS)


def occurrences(found: DataFrame) -> DataFrame:
    """(n_words, occurrences, doc_ids, starts) of every maximal repeat in the rows of `maximal`, its occurrences by id and place.

    The lists of nested repeats repeat their members: their sizes add up to more than the rows.
    """
    inner = found.select("repeat_id", "place", F.explode("longer").alias("r")).select("repeat_id", F.col("place").alias("first"), "r.n_words", "r.occurrences")
    outer = found.where("place = 0").select("repeat_id", F.col("place").alias("first"), "n_words", "occurrences")
    members = found.select("repeat_id", "place", "doc_id", "start")
    met = outer.unionByName(inner).join(members, "repeat_id").where("place >= first AND place < first + occurrences")
    rows = met.groupBy("repeat_id", "first", "n_words", "occurrences").agg(F.sort_array(F.collect_list(F.struct("doc_id", "start"))).alias("o"))
    return rows.select("n_words", "occurrences", F.col("o.doc_id").alias("doc_ids"), F.col("o.start").alias("starts"))


def _sorted(texts: list[bytes], owner: np.ndarray, at: np.ndarray, most: int, width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted suffixes that start at word `at` of text `owner`, `width` bytes a word, and
    for each in that order the words that it shares with the one before (0 for the first)."""
    sizes = np.array([len(t) for t in texts])
    copied = int((sizes[owner] - width * at).sum())
    if copied > most and copied > 8 * sizes.sum():
        return _doubled(texts, owner, at, width)
    suffixes = [texts[o][width * k :] for o, k in zip(owner.tolist(), at.tolist())]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__))
    arrays = [np.frombuffer(suffixes[k], np.uint8) for k in order.tolist()]
    common = np.zeros(len(suffixes), np.int64)
    for i in range(1, len(suffixes)):
        a, b = arrays[i - 1], arrays[i]
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        k = int(differ.argmax()) if n else 0
        common[i] = (k if n and differ[k] else n) // width
    return order, common


def _doubled(texts: list[bytes], owner: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without a copy of each suffix: ranks of runs of 1, 2, 4, ... words, for texts that repeat themselves."""
    sizes = np.array([len(t) // width for t in texts])
    ends = np.cumsum(sizes)
    raw = np.zeros((int(ends[-1]), 8), np.uint8)
    raw[:, 8 - width :] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, width)
    left = np.repeat(ends, sizes) - np.arange(ends[-1])  # words from here to the text's end
    ranks = [np.unique(raw.view(">u8").ravel(), return_inverse=True)[1].astype(np.int64) + 1]
    span, spot = 1, (ends - sizes)[owner] + at
    while span < sizes.max():
        beyond = np.zeros(len(left), np.int64)
        beyond[:-span] = ranks[-1][span:]
        beyond[left <= span] = 0
        ranks.append(np.unique(ranks[-1] * (len(left) + 1) + beyond, return_inverse=True)[1].astype(np.int64) + 1)
        span *= 2
    order = np.argsort(ranks[-1][spot], kind="stable")
    one, two = spot[order][:-1].copy(), spot[order][1:].copy()
    shared, room = np.zeros(len(one), np.int64), np.minimum(left[one], left[two])
    for level in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(one + shared, len(left) - 1), np.minimum(two + shared, len(left) - 1)
        same = (shared < room) & (ranks[level][x] == ranks[level][y])
        shared[same] = np.minimum(shared + (1 << level), room)[same]
    return order, np.concatenate([[0], shared])


def intervals(common: np.ndarray, lefts: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(words, first, last + 1) of every left-diverse interval of sorted suffixes, by the words shared with the one before."""
    common = [*common.tolist(), 0]
    stack: list[list] = [[0, 0, None]]  # length, first suffix, the word before all of them (None: they differ)
    for i in range(1, len(common)):
        first, left = i - 1, (int(lefts[i - 1]) if lefts[i - 1] != START else None)
        while stack[-1][0] > common[i]:
            length, first, before = stack.pop()
            left = before if before == left else None
            if left is None and length >= least:
                yield length, first, i
        if stack[-1][0] < common[i]:
            stack.append([common[i], first, left])
        elif stack[-1][2] != left:
            stack[-1][2] = None


def _trees(least: int, copied: int):
    """The repeats of every key's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        number, now, held = 0, None, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal found, number
            for x in _repeats(held, least, copied):
                found.append(x)
                number += len(x[2])
                if number > BATCH:
                    yield _rows(found)
                    found, number = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and held:
                    yield from close()
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield from close()
        if found:
            yield _rows(found)

    return run


def _repeats(rows: list[tuple], least: int, copied: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[tuple[int, int]]]]]:
    """(repeat_id, words, docs, starts, longer) of every outermost repeat of a key."""
    starts = [np.frombuffer(r[2], np.int64) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in starts])
    texts = [r[4] for r in rows]
    order, common = _sorted(texts, owner, np.concatenate([x - x[0] for x in starts]), copied)
    doc = np.array([r[1] for r in rows])[owner][order]
    place = np.concatenate(starts)[order]
    left = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])[order]
    end = 0
    for length, a, b in sorted(intervals(common, left, least), key=lambda x: (x[1], -x[2])):
        if a >= end:  # outermost; the ones within it follow
            if end:
                yield root
            longer: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
            begin, end, k = a, b, int(order[a])
            at = 6 * int(starts[owner[k]][0] * -1 + place[a])
            name = xxhash.xxh64_intdigest(texts[owner[k]][at : at + 6 * least]) >> 1
            root = (name, length, doc[a:b], place[a:b], longer)
        else:
            longer[a - begin].append((length, b - a))
    if end:
        yield root


def _rows(found: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([len(f[2]) for f in found])
    number = np.repeat(sizes, sizes)
    place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    nested = [x for f in found for x in f[4]]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nested])]).astype(np.int32))
    pairs = np.array([y for x in nested for y in x], np.int64).reshape(-1, 2)
    inner = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["n_words", "occurrences"])
    columns = [np.repeat([f[0] for f in found], sizes), np.repeat([f[1] for f in found], sizes), number, place, np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.ListArray.from_arrays(offsets, inner)], ["repeat_id", "n_words", "occurrences", "place", "doc_id", "start", "longer"])
