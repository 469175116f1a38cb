"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative;
the run of tokens with the greatest sum is the content. One linear scan finds it:
prefix sums less their running minimum. What a tag costs, by its name, and a word
within a link, comes from labelled pages: pages whose own markup names their
article (an `article` element), a bounded sample of them. The `article` tags
themselves tell nothing at extraction: they are scored as unknown tags.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages that the weights are fitted on (those of least hashed id).
SAMPLE = 2000
#: What a tag costs at least, and scales of the costs that are tried on the labelled pages.
FLOOR, SCALES = 0.05, (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)

_TAG = re.compile(r"</?([a-zA-Z][\w-]*)[^<>]*>")
_HIDDEN = re.compile(r"<(script|style|noscript|template)\b", re.I)
_BLOCK = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "blockquote", "pre"}


def tokens(html: str) -> list[tuple[str | None, str]]:
    """(tag name or None, word) of a page; comments, scripts and styles are tags named '!'. Time is linear in the page."""
    out, at, size, bracket = [], 0, len(html), 0

    def closing(start: int) -> int:
        """The first '>' from `start` on, or -1; looked for once, however many tags stay open."""
        nonlocal bracket
        if 0 <= bracket < start:
            bracket = html.find(">", start)
        return bracket

    while at < size:
        begin = html.find("<", at)
        out += [(None, w) for w in (html[at:begin] if begin >= 0 else html[at:]).split()]
        if begin < 0:
            break
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            out.append(("!", ""))
            at = end + 3 if end >= 0 else size
        elif (m := _HIDDEN.match(html, begin)) and closing(m.end()) >= 0:
            end = re.compile(rf"</{m[1]}\s*>", re.I).search(html, bracket + 1)
            out.append(("!", ""))
            at = end.end() if end else size
        elif m := _TAG.match(html, begin):
            out.append((m[1].lower(), "/" if m[0][1] == "/" else ""))
            at = m.end()
        elif html[begin + 1 : begin + 2] in ("!", "?") and closing(begin + 2) >= 0:
            out.append(("!", ""))
            at = bracket + 1
        else:
            out.append((None, "<"))
            at = begin + 1
    return out


def scores(page: list[tuple[str | None, str]], weights: dict[str, float]) -> np.ndarray:
    """The score of every token: 1 a word, `a` a word in a link, less the cost of a tag."""
    out, linked = np.empty(len(page)), False
    word, link, other = 1.0, weights.get(" link", 1.0), weights.get(" other", 1.0)
    for i, (tag, text) in enumerate(page):
        if tag is None:
            out[i] = link if linked else word
        else:
            if tag == "a":
                linked = text == ""
            out[i] = -weights.get(tag, other)
    return out


def best(score: np.ndarray) -> tuple[int, int]:
    """[start, end) of the run of greatest positive sum: the first to end, then the longest; (0, 0) if none."""
    if not len(score):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(sums[:-1])
    gain = sums[1:] - low
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0
    return int(np.argmax(sums[: end + 1] == low[end])), end + 1


def fit(pages: list[str]) -> dict[str, float]:
    """Costs by tag name, from pages with an article: log-odds to lie outside, then the scale of best F1."""
    inside, outside, cases = Counter(), Counter(), []
    for html in pages:
        page = tokens(html)
        marks = [i for i, (tag, _) in enumerate(page) if tag == "article"]
        if len(marks) < 2:
            continue
        cases.append((page, marks[0], marks[-1]))
        linked = False
        for i, (tag, text) in enumerate(page):
            if tag == "a":
                linked = text == ""
            if tag != "article":
                (inside if marks[0] < i < marks[-1] else outside)[(" link" if linked else " word") if tag is None else tag] += 1
    if not cases:
        return {}
    odds = {k: math.log((outside[k] + 0.5) / (inside[k] + 0.5)) for k in inside | outside}
    base = odds.get(" word", 0.0)
    costs = {k: max(FLOOR, v - base) for k, v in odds.items() if k[0] != " "}
    link = 1.0 if odds.get(" link", base) <= base else FLOOR

    def quality(weights: dict[str, float]) -> float:
        got = right = want = 0
        for page, a, b in cases:
            word = np.array([tag is None for tag, _ in page])
            x, y = best(scores(page, weights))
            got += word[x:y].sum()
            want += word[a:b].sum()
            right += word[max(a, x) : max(max(a, x), min(b, y))].sum()
        return 2 * right / max(1, got + want)

    tried = [{k: v * s for k, v in costs.items()} | {" link": link, " other": s} for s in SCALES]
    return max(tried, key=quality)


def content(html: str, weights: dict[str, float]) -> tuple[str, int]:
    """The text of the best region, a line for each block, and its words."""
    page = tokens(html)
    a, b = best(scores(page, weights))
    parts, number = [], 0
    for tag, text in page[a:b]:
        if tag is None:
            parts.append(entities.unescape(text))
            number += 1
        elif tag in _BLOCK:
            parts.append("\n")
    lines = (" ".join(x.split()) for x in " ".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), number


def trained(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """The weights from the `sample` pages with an article of least hashed id."""
    rows = pages.where(F.col("page_id").isNotNull() & F.lower("html").contains("<article")).select("page_id", "html")
    order = [F.xxhash64("page_id"), F.col("page_id")]
    ids = rows.select("page_id").orderBy(*order).limit(sample)  # ids alone go to the driver from every task
    chosen = pages.sparkSession.createDataFrame(ids.collect(), ids.schema)
    found = rows.join(F.broadcast(chosen), "page_id", "left_semi").orderBy(*order, "html").limit(sample).collect()
    return fit([r["html"] for r in found])


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, text, n_words) of every row.

    A null page has a null text and no words; an empty one, or one without words,
    the empty text. Without labelled pages every tag costs as much as a word gives. Of runs of equal score
    the first to end counts, and of those the longest. Rows that repeat an id, or have none, are extracted each
    for itself, however long the page; an empty table gives no row; other columns, whatever their names, are dropped.
    """
    weights = trained(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, 0) if h is None else content(h, weights) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["page_id", "text", "n_words"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_words long")
