"""Byte-level BPE by backtracking over longest matches, and its inverse.

A text is split by the vocabulary's pattern, and each piece, as bytes mapped to
Latin-1, scanned once by an Aho-Corasick automaton of all tokens, which gives the
longest token at every place. From left to right the longest token is taken; if it
can't follow the one before, or ends where no encoding goes on, its next shorter
prefix token is tried, and with none left the token before is given up and its
end barred. Two tokens can follow each other iff merging their joined bytes gives
just these two; that is found by undoing merges at the seam and memoised. Every
place is barred at most once, so the time is linear, and the tokens are those of
the merges applied in order of rank.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import pieces

#: A file of base64 tokens and ranks, and the pattern that splits texts for it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces in each of the two generations of a worker's memory: a full one becomes the old one, and what is
#: met again in the old one moves to the new.
REMEMBERED = 1 << 17
#: Characters up to which a piece is remembered (so the memory is bounded in bytes too), and bytes up to which
#: its longest matches are looked up one by one.
SHORT = 40
#: Slots for remembered pairs of tokens (8 bytes each); a pair takes the place of the one before it.
PAIRS = (1 << 20) - 3


class Codec(dict):
    """Encodes and decodes with one vocabulary; as a dict, the pieces met lately."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__()
        self.old: dict[str, bytes] = {}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        if absent := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path} has no token for {len(absent)} of the 256 bytes, so not every text can be encoded")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.sizes = [len(t) for t in self.bytes]
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(self.bytes)
        self.base = len(self.bytes)
        self.fits = array("q", [-2]) * PAIRS
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
            else:
                one, two = self._last_merge(token, rank)
                self.parts[rank] = (one, two)
                self.pairs[one, two] = rank
        self.automaton.make_automaton()

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes `token`."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            low, k = min(found)
            if low >= rank:
                raise ValueError(f"no merges lead to token {rank}")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, one: int, two: int) -> bool:
        """Whether no merge at the seam comes before those that made the tokens."""
        pairs, parts = self.pairs, self.parts
        before = len(self.bytes) + 1  # only merges below this rank came earlier
        while True:
            merged = pairs.get((one, two))
            if merged is not None and merged < before:
                return False
            for left in (one > two, one <= two):  # undo the later of the two merges
                if left and parts[one][1] != one:
                    before, one = one, parts[one][1]
                    break
                if not left and parts[two][0] != two:
                    before, two = two + 1, parts[two][0]
                    break
            else:
                return True

    def _fitting(self, one: int, two: int) -> int:
        """The longest of `two` and its prefix tokens that can follow `one` (-1: none), remembered in a table of fixed size."""
        pair, fit = one * self.base + two, two
        while fit >= 0 and not self._compatible(one, fit):
            fit = self.shorter[fit]
        self.fits[pair % PAIRS] = pair << 20 | fit + 1
        return fit

    def _longest(self, latin: str) -> list[int]:
        """The longest token at every place."""
        longest, reach, sizes = [0] * len(latin), [0] * len(latin), self.sizes
        for end, rank in self.automaton.iter(latin):
            at = end - sizes[rank] + 1
            if sizes[rank] > reach[at]:
                longest[at], reach[at] = rank, sizes[rank]
        return longest

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece."""
        raw = text.encode()
        if raw in self.ranks:  # a token is the encoding of its own bytes: `_last_merge` found the merges
            return [self.ranks[raw]]
        latin = raw.decode("latin-1")
        size, sizes, shorter, fits, base = len(raw), self.sizes, self.shorter, self.fits, self.base
        scan, longest = self.automaton.iter_long, self._longest(latin) if size > SHORT else None  # a call copies the piece
        token = longest[0] if longest else next(scan(latin, 0))[1]
        out, open_, at, before = [], bytearray(b"\1") * (size + 1), 0, -1
        while True:
            if before >= 0 and token >= 0:
                pair = before * base + token
                seen = fits[pair % PAIRS]
                token = (seen & 0xFFFFF) - 1 if seen >> 20 == pair else self._fitting(before, token)
            if token < 0:  # nothing fits here: give up the token before
                open_[at] = 0
                token = out.pop()
                before = out[-1] if out else -1
                at -= sizes[token]
            elif open_[at + sizes[token]]:
                out.append(token)
                at, before = at + sizes[token], token
                if at == size:
                    return out
                token = longest[at] if longest else next(scan(latin, at))[1]
                continue
            token = shorter[token]

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = array("i", self.piece(text)).tobytes()
            if len(text) > SHORT:
                return found
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a text."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), np.int32)

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes that the tokens stand for."""
        return b"".join(map(self.bytes.__getitem__, tokens.tolist()))


@lru_cache(maxsize=2)
def codec(path: str = RANKS, pattern: str = PATTERN) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, intact) of every row.

    `intact` tells that the decoded tokens are the text again, byte by byte. A null
    text has null tokens, null n_tokens and null `intact`; the empty text has no tokens. Rows that
    repeat an id, or have none, are encoded each for itself. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for i, j, data, bounds in pieces(batch.column(1)):
                column = batch.column(1).slice(i, j - i)
                raw, null = data.tobytes(), column.is_null().to_numpy(zero_copy_only=False)
                tokens = [tool.encode(raw[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:])]
                same = [tool.decode(t) == raw[a:b] for t, a, b in zip(tokens, bounds[:-1], bounds[1:])]
                sizes = np.array([len(t) for t in tokens])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(sizes, mask=null), pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "intact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens array<int>, n_tokens long, intact boolean")


def decoded(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of rows with `tokens`; null tokens give a null text, bytes that are no UTF-8 the replacement sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = [None if t is None else b"".join(map(tool.bytes.__getitem__, t)).decode(errors="replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")
