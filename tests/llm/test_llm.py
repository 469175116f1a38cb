"""The ten operators against brute force, on awkward rows and at held-out accuracy."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import byte_bpe, decontaminate, exact_dedup, html_extract, language_id, line_dedup, ngram_join, repeats, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, a column that clashes."""
    long = " ".join(f"word{i % 977}" for i in range(30000))
    rows = [(1, None, None, None), (None, "no id here at all", "en", "a"), (2, "", "en", "a"), (3, "", None, "a"), (4, long, "en", "b"), (5, long, "en", "b"), (6, "same same same", "fr", None), (6, "same same same", "fr", None), (6, "another text of six", "en", "b"), (7, "x", "de", "c"), (8, "  \n\n ", "en", "c")]
    from pyspark.sql import functions as F

    return frame(spark, rows).withColumn("score", F.lit(1)).withColumn("n_dropped", F.lit("x")).withColumn("rank", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(docs, n, t):
    sets = {}
    for i, text in docs:
        w = text.split()
        if len(w) >= n:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b): round(len(x & y) / len(x | y), 4) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if len(x & y) / len(x | y) >= t - 1e-9}


def near_docs(rng, number=120, vocabulary=40):
    vocab = [f"w{i}" for i in range(vocabulary)]
    docs = []
    for i in range(number):
        if docs and rng.random() < 0.5:
            w = list(rng.choice(docs)[1].split())
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 20, 60, 150]))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("pairs_from,triples_from", [(10, 14), (1, 63), (1, 2)])
def test_join_equals_brute_force(spark, monkeypatch, pairs_from, triples_from):
    monkeypatch.setattr(ngram_join, "SMALL", 12)
    keys = np.sort(np.array([(r << 58) | i for i, r in enumerate(random.Random(1).choices(range(4), k=90))], np.uint64))
    monkeypatch.setattr(ngram_join, "PAIRS_FROM", pairs_from)
    monkeypatch.setattr(ngram_join, "TRIPLES_FROM", triples_from)
    # the index alone: any two sets that reach the threshold share an entry
    rng = np.random.default_rng(5)
    for t in (0.5, 0.6, 0.8):
        for size in (3, 9, 14, 30, 70):
            x = np.sort(rng.choice(keys, size, replace=False))
            for _ in range(20):
                y = np.union1d(rng.choice(x, max(1, size - int(rng.integers(0, 1 + size // 4))), replace=False), rng.choice(keys, int(rng.integers(0, 1 + size // 5))))
                if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= t:
                    a, b = (set((ngram_join.index_of(k, t)[0] >> np.uint64(16)).tolist()) for k in (x, y))
                    assert a & b, (t, size)


def test_join_order_tells_rare_tokens_from_others_in_crowded_counters():
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 120) % 5000) for _ in range(400)]
    i, grams, first, hashes, starts = next(ngram_join._counted(pa.array(texts), 2))
    tokens = rng.poisson(1400, ngram_join.COUNTERS)  # as many other tokens share the counters at 6 GB
    for a, b in zip(first, first[1:]):
        np.add.at(tokens, np.unique(grams[a:b]) >> np.uint64(44), 1)
    singly = np.bincount(hashes >> np.uint64(44), minlength=ngram_join.COUNTERS)
    load = tokens.sum() / len(tokens)
    counters_alone = np.log2(1 + np.maximum(tokens - load, 0) / max(1.0, math.sqrt(load) / 8)).astype(np.uint64)[grams >> np.uint64(44)]

    def met(rank):
        """Pairs of texts that the index brings together."""
        keys, cuts = ngram_join._sets(ngram_join.keyed(grams, rank), first)
        _, met = np.unique(np.concatenate([ngram_join.index_of(keys[a:b], 0.6)[0] >> np.uint64(16) for a, b in zip(cuts, cuts[1:])]), return_counts=True)
        return int((met * (met - 1) // 2).sum())

    rank = ngram_join.ranked(grams, first, hashes, starts, 2, ngram_join.scales(tokens, singly))
    assert len({*zip(grams.tolist(), rank.tolist())}) == len(np.unique(grams))  # a token has one rank wherever it stands
    assert met(rank) * 4 < met(counters_alone)


def test_join_rows_equal_brute_force(spark):
    docs = near_docs(random.Random(2))
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id_a, r.id_b): r.jaccard for r in ngram_join.similar(frame_).collect()}
    want = pairs_of(docs, ngram_join.WORDS, ngram_join.THRESHOLD)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    kept = {r.doc_id for r in ngram_join.without_near_copies(frame_).collect()}
    classes = {r.doc_id: (r.class_id, r.links) for r in ngram_join.classes(frame_).collect()}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert kept == {i for i, _ in docs if root(i) == i}
    assert classes == {i: (root(i), sum(i in pair for pair in got)) for i, _ in docs}


def test_join_of_an_id_with_several_texts(spark):
    long, short = (" ".join(f"{c}{i}" for i in range(k)) for c, k in (("l", 400), ("s", 40)))
    rows = [(7, long), (7, short), (7, short), (9, short + " end"), (11, long), (12, "nothing like it"), (12, "of another kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id_a, r.id_b) for r in ngram_join.similar(docs).collect()} == {(7, 9), (7, 11)}
    assert {tuple(r) for r in ngram_join.classes(docs).collect()} == {(7, 7, 2), (9, 7, 1), (11, 7, 1), (12, 12, 0)}
    assert sorted(r.doc_id for r in ngram_join.without_near_copies(docs).collect()) == [7, 7, 7, 12, 12]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(i, root(i)) for a, b in edges if a != b for i in (a, b)}
    frame_ = spark.createDataFrame(edges, "a long, b long")
    for together in (1 << 20, 0):
        assert {tuple(r) for r in ngram_join.components(frame_, together).collect()} == want


def test_join_in_passes(spark, monkeypatch):
    for name, value in (("PASS", 30), ("FIRST_FROM", 1), ("FIRST", 4), ("KNOWN_FROM", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    assert ngram_join.passes(60, True) == [0, 0.5, 1] and ngram_join.passes(60, False) == [0, 0.25, 0.625, 1]
    docs = near_docs(random.Random(12), 60)
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    want = pairs_of(docs, ngram_join.WORDS, ngram_join.THRESHOLD)
    least = {i: i for i, _ in docs}
    for _ in docs:
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    links = {i: sum(i in pair for pair in want) for i, _ in docs}
    assert {tuple(r) for r in ngram_join.classes(frame_).collect()} == {(i, least[i], links[i]) for i, _ in docs}
    assert {r.doc_id for r in ngram_join.without_near_copies(frame_).collect()} == {i for i, _ in docs if least[i] == i}


def test_pairs_of_a_large_group_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FIRST_FROM", 1, raising=False)
    rng, keep, made = random.Random(5), ngram_join.stored, []

    def counted(df, name):
        table = keep(df, name)
        if name == "pairs":
            made.append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "stored", counted)
    words_, number = [f"w{k}" for k in range(100)], 200
    docs = []
    for i in range(number):
        w = list(words_)
        for k in rng.sample(range(100), 4):
            w[k] = f"x{i}y{k}"
        docs.append((i, " ".join(w)))
    assert [r.doc_id for r in ngram_join.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [0]
    assert sum(made) < number * (number - 1) / 2 / 4


def test_common_phrases_are_not_indexed_one_by_one():
    text = pa.array([" ".join(f"w{k}" for k in range(60))])
    _, grams, first, hashes, starts = next(ngram_join._counted(text, 2))
    tokens = np.random.default_rng(3).poisson(1400, ngram_join.COUNTERS)  # a table of 6 GB, of which one in 150 documents has the phrase
    tokens[grams >> np.uint64(44)] += 20_000
    singly = np.full(ngram_join.COUNTERS, 50)
    singly[hashes >> np.uint64(44)] += 20_000
    rank = ngram_join.ranked(grams, first, hashes, starts, 2, ngram_join.scales(tokens, singly))
    assert (rank >= ngram_join.PAIRS_FROM).all()


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 100)  # a group is cut into many blocks
    docs = near_docs(random.Random(12), 60)
    got = {(r.id_a, r.id_b) for r in ngram_join.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == pairs_of(docs, ngram_join.WORDS, ngram_join.THRESHOLD).keys()


def test_join_awkward(spark, awkward, empty):
    assert {(r.id_a, r.id_b) for r in ngram_join.similar(awkward).collect()} == {(4, 5)}
    assert {tuple(r) for r in ngram_join.classes(awkward).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (8, 8, 0)}
    assert ngram_join.classes(empty).count() == 0
    left = ngram_join.without_near_copies(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 1
    assert ngram_join.similar(empty).count() == 0 and ngram_join.without_near_copies(empty).count() == 0


def test_exact_dedup_small_blocks(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = [(i, rng.choice(texts)) for i in range(200)]
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.copies(spark.createDataFrame(docs, "doc_id long, text string"), block=4).collect()}
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    assert got == {(i, first[t]) for i, t in docs if first[t] != i}


def test_exact_dedup_awkward(spark, awkward, empty):
    assert {tuple(r) for r in exact_dedup.copies(awkward).collect()} == {(3, 2), (5, 4)}
    left = exact_dedup.without_copies(awkward)
    assert left.columns == awkward.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == sorted((i, t) for i, t in {((r.doc_id or 0), r.text or "") for r in awkward.collect()} if i not in (3, 5))
    assert exact_dedup.copies(empty).count() == 0 and exact_dedup.without_copies(empty).count() == 0


def brute_repeats(docs, least):
    words = [t.split() for _, t in docs]
    now, out, length = {}, set(), least
    for i, w in enumerate(words):
        for s in range(len(w) - least + 1):
            now.setdefault(tuple(w[s : s + least]), []).append((i, s))
    now = {k: v for k, v in now.items() if len(v) > 1}
    while now:
        longer = {}
        for k, v in now.items():
            ends = any(s + length == len(words[i]) for i, s in v) or len({words[i][s + length] for i, s in v}) > 1
            begins = any(s == 0 for i, s in v) or len({words[i][s - 1] for i, s in v}) > 1
            if ends and begins:
                out.add((length, tuple(sorted((docs[i][0], s) for i, s in v))))
            for i, s in v:
                if s + length < len(words[i]):
                    longer.setdefault((*k, words[i][s + length]), []).append((i, s))
        now, length = {k: v for k, v in longer.items() if len(v) > 1}, length + 1
    return out


@pytest.mark.parametrize("copied", [1 << 24, 0])
def test_repeats_equal_brute_force(spark, monkeypatch, copied):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(40)] for _ in range(5)]
    docs = []
    for i in range(30):
        w = []
        for _ in range(rng.randint(0, 4)):
            b = list(rng.choice(base))[rng.randint(0, 20) :]
            if rng.random() < 0.4:
                b[rng.randrange(len(b))] = f"x{rng.randint(0, 5)}"
            w += b + [rng.choice(vocab) for _ in range(rng.randint(0, 6))]
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join(["a", "b", "c"] * 12)), (101, docs[3][1]), (102, docs[3][1])]
    monkeypatch.setattr(repeats, "COPIED", copied)
    found = repeats.maximal(spark.createDataFrame(docs, "doc_id long, text string"), 8, 3)
    got = {(r.n_words, tuple(zip(r.doc_ids, r.starts))) for r in repeats.occurrences(found).collect()}
    assert got == brute_repeats(docs, 8)
    assert {r.repeat_id for r in found.where("place = 0").collect()} == {r.repeat_id for r in found.collect()}


def test_repeats_awkward(spark, awkward, empty):
    rows = repeats.maximal(awkward).collect()
    assert max([r.n_words, *(x.n_words for x in r.longer)][-1] for r in rows) == 30000 and {r.doc_id for r in rows} == {4, 5}
    assert repeats.maximal(empty).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 15, 30])))) for i in range(20)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "zz"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((i, " ".join(w)))
    want = {}
    for i, t in items:
        g = [tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)]
        for d, text in docs:
            h = [tuple(text.split()[k : k + 3]) for k in range(len(text.split()) - 2)]
            most = max((len(set(h[k : k + len(g)]) & set(g)) for k in range(len(h))), default=0)
            if g and most >= math.ceil(0.6 * len(set(g)) - 1e-9):
                want[d, i] = most
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for group in (1 << 20, 25):  # one pass, and several over the documents
        assert {(r.doc_id, r.item_id): r.shared for r in decontaminate.leaks(*frames, group=group).collect()} == want


def test_leaks_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, "word0 word1 word2 word3 word4"), (None, "word5 word6 word7"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, items).collect()} == {(4, 1), (5, 1)}
    left = decontaminate.clean(awkward, items)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 2
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(awkward, items.limit(0)).count() == 0


def test_line_dedup(spark, awkward, empty):
    rows = [(i, f"menu\nline {i}\nmenu\n\nend", None, "a") for i in range(10)] + [(i, "menu\nother", None, None) for i in range(10, 12)] + [(12, None, None, "a")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.cleaned(frame(spark, rows), ratio=0.5, pages=3).collect()}
    assert got == {i: (f"line {i}\n", 3) for i in range(10)} | {10: ("menu\nother", 0), 11: ("menu\nother", 0), 12: (None, 0)}
    found = line_dedup.boilerplate(frame(spark, rows), 0.5, 3)
    by_rows = line_dedup._by_rows(frame(spark, rows), found, "source", ["doc_id", "text"])
    assert {r.doc_id: (r.text, r.n_dropped) for r in by_rows.collect()} == got
    assert line_dedup.cleaned(awkward).count() == awkward.count() and line_dedup.cleaned(empty).count() == 0


def test_bpe_equals_merges_and_round_trips(spark, awkward):
    import public_tokenizers
    import tiktoken

    tool = byte_bpe.codec()
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("ab thehe's  \n\té漢🙂123!!_ ing") for _ in range(rng.randint(0, 60)))
        assert tool.encode(text).tolist() == whole.encode_ordinary(text)
        assert tool.decode(tool.encode(text)) == text.encode()
    for text in ("a" * 20000, "".join(rng.choice("abcdefgh0123") for _ in range(3000)), "é漢" * 500):
        assert tool.encode(text).tolist() == whole.encode_ordinary(text)
    assert tool.piece("a" * 20000) == whole.encode_ordinary("a" * 20000)
    rows = {(r.doc_id, r.n_tokens is None, r.intact) for r in byte_bpe.encoded(awkward).collect()}
    assert (1, True, None) in rows and {x[2] for x in rows} == {None, True}
    back = {(r.doc_id, r.text) for r in byte_bpe.decoded(byte_bpe.encoded(awkward)).collect()}
    assert back == {(r.doc_id, r.text) for r in awkward.collect()}


def test_language_id(spark, awkward, empty):
    rng = random.Random(6)
    syllables = {"xx": "the ing and er on".split(), "yy": "der ein sch ung heit".split()}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), k, "s") for i, k in enumerate(rng.choices(["xx", "yy"], k=300))]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(docs, sample=150).collect()}
    assert sum(got[i].predicted == k for i, _, k, _ in rows) >= 295
    assert sum(r.rejected for r in got.values()) <= 5 and language_id.accepted(docs, 150).columns == docs.columns
    other = {r.doc_id: r for r in language_id.identify(awkward.where("doc_id IS NULL OR doc_id <> 6")).collect()}
    assert len(other) == 8 and other[1].predicted is None and other[2].rejected
    assert language_id.identify(empty).count() == 0
    unlabelled = [r.rejected for r in language_id.identify(frame(spark, [(1, "text", None, None)])).collect()]
    assert unlabelled == [False]


def test_language_id_keeps_its_error_and_rejects_foreign_text(spark):
    rng = random.Random(16)
    syllables = {"xx": "the ing and er on".split(), "yy": "der ein sch ung heit er on".split(), "no": "czy prze szcz ow jak".split()}

    def text(k, least=1):
        return " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(rng.randint(least, 30)))

    rows = [(text(k), k) for k in rng.choices(["xx", "yy"], k=500)]
    model = language_id.fit(*map(list, zip(*rows)))
    fresh = [(text(k), k) for k in rng.choices(["xx", "yy"], k=1000)]
    best, sure, rejected = language_id._judged(model, pa.array([t for t, _ in fresh]))
    wrong = np.array([model.languages[b] != k for b, (_, k) in zip(best, fresh)])
    assert wrong[~rejected].mean() <= 1.5 * language_id.ERRORS and rejected.mean() < 0.05
    assert language_id._judged(model, pa.array([text("no", 5) for _ in range(200)]))[2].mean() > 0.95
    # the vectorised score against one that goes from subword to subword
    for t, _ in fresh[:40]:
        bucket, _ = language_id.subwords(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        slow = sum((model.logits[b].astype(float) for b in bucket), np.zeros(2)) / len(bucket) + model.bias
        _, quick, _, _ = next(language_id.logits(model, pa.array([t])))
        assert np.allclose(slow, quick[0], atol=1e-4)


def test_toxicity_is_learnt_and_fair(spark, awkward, empty):
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for _ in range(900):
        bad = rng.random() < 0.3
        w = rng.choices(plain, k=rng.randint(5, 60)) + (["idiot"] if bad else []) + (["muslim"] if bad and rng.random() < 0.7 else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(bad))
    fair, unfair = toxicity.fit(texts, labels), toxicity.fit(texts, labels, fair=0.0)
    fresh = [" ".join(rng.choices(plain, k=20)) for _ in range(60)]
    bad = [t + " idiot" for t in fresh]
    neutral = [t + " muslim women" for t in fresh]
    assert np.mean(fair.scores(pa.array(bad)) >= fair.least) > 0.95 and np.mean(fair.scores(pa.array(fresh)) >= fair.least) < 0.05
    move = lambda m: np.abs(m.scores(pa.array(neutral)) - m.scores(pa.array(fresh))).mean()
    assert np.mean(fair.scores(pa.array(neutral)) >= fair.least) < 0.05 and move(fair) < move(unfair)
    label = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (3, None, None)], label)
    flagged = {r.doc_id for r in toxicity.flagged(docs, marks).collect()}
    assert len(flagged ^ {i for i, y in enumerate(labels) if y}) < 20
    assert toxicity.scored(awkward, marks.limit(0)).where("score IS NOT NULL OR toxic").count() == 0
    assert toxicity.scored(awkward, marks).count() == awkward.count() and toxicity.scored(empty, marks).count() == 0


def test_html(spark):
    rng = random.Random(2)
    for _ in range(300):
        score = np.array([rng.choice([1, 1, -1, -2, 0.5]) for _ in range(rng.randint(0, 14))])
        a, b = html_extract.best(score)
        most = max((score[i:j].sum() for i in range(len(score)) for j in range(i + 1, len(score) + 1)), default=0)
        assert math.isclose(score[a:b].sum(), max(0, most), abs_tol=1e-9)
    page = "<html><script>var a='<p>x</p>'</script><nav>{}</nav><article><h1>Title here</h1><p>{}</p></article><footer>end</footer></html>"
    text = [" ".join(f"w{i}{k}" for k in range(30)) for i in range(40)]
    pages = [(i, page.format("".join(f"<a href='/{k}'>m{k}</a>" for k in range(6)), t)) for i, t in enumerate(text)]
    pages += [(100, None), (101, ""), (102, "<br><br>"), (None, "a < b &amp; c"), (5, pages[5][1])]
    got = html_extract.extracted(spark.createDataFrame(pages, "page_id long, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages) and all(by[i].text == f"Title here\n{t}" for i, t in enumerate(text))
    assert by[100].text is None and by[101].text == "" and by[102].n_words == 0 and by[None].text == "a < b & c"
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_url_filter(spark):
    assert url_filter.parts("HTTP://u@Host.Example:80/Path?q#f") == ("host.example", "/path?q")
    rows = [(1, "https://www.big-casino-pills.example.org/en/3"), (2, "https://blog.northern.example.net/en/7"), (3, None), (4, ""), (1, "https://blog.northern.example.net/en/7")]
    got = sorted((r.page_id, r.blocked) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == [(1, False), (1, True), (2, False), (3, False), (4, got[-1][1])]
    labelled = url_filter.labelled_urls()
    right = found = wanted = 0
    for k in range(8):  # held-out folds
        weights, bias = url_filter.fit([x for i, x in enumerate(labelled) if i % 8 != k])
        for u, y in labelled[k::8]:
            hit = url_filter._score(weights, bias, url_filter.buckets(u)) > 0
            right, found, wanted = right + (hit and y), found + hit, wanted + y
    assert right / found > 0.85 and right / wanted > 0.85, (right / found, right / wanted)


def test_url_filter_awkward(spark):
    long = "https://a.example/" + "slots-poker/" * 20000
    rows = [(1, long, 1.0, "b"), (1, long, 1.0, "b"), (None, "http://x.example", None, None), (2, None, None, None), (3, "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score double, blocked string")
    got = url_filter.judged(pages).collect()
    assert len(got) == 5 and {r.blocked for r in got if r.url == long} == {True} and {r.score for r in got if r.url is None} == {None}
    assert url_filter.judged(pages.limit(0)).count() == 0
    for labels in ([], [("http://only.example", 1)]):
        assert {(r.score, r.blocked) for r in url_filter.judged(pages, spark.createDataFrame(labels, "url string, unwanted int")).collect()} == {(None, False)}
    # the score against one counted n-gram by n-gram
    weights, bias = url_filter.fit(url_filter.labelled_urls())
    url = "https://Www.Lucky-Poker.example/Play?x=1#y"
    grams = {(k, p[i : i + n]) for k, p in enumerate(("^www.lucky-poker.example$", "^/play?x=1$")) for n in (3, 4, 5) for i in range(len(p) - n + 1)}
    half = url_filter.BUCKETS // 2
    slots = {k * half + zlib.crc32(g.encode()) % half for k, g in grams}
    score = 1 / (1 + math.exp(-(bias + sum(weights[x] for x in slots) / math.sqrt(len(slots)))))
    row = url_filter.judged(spark.createDataFrame([(9, url)], "page_id long, url string")).first()
    assert math.isclose(row.score, score, abs_tol=1e-4)


def test_html_held_out_pages_and_linear_time(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labelled = [r.html for r in pages.where("html LIKE '%<article%'").orderBy("page_id").collect()]
    weights = html_extract.fit(labelled[::2])
    right = found = wanted = 0
    for html in labelled[1::2]:
        page = html_extract.tokens(html)
        marks = [i for i, (tag, _) in enumerate(page) if tag == "article"]
        word = np.array([tag is None for tag, _ in page])
        a, b = html_extract.best(html_extract.scores(page, weights))
        found, wanted, right = found + word[a:b].sum(), wanted + word[marks[0] : marks[-1]].sum(), right + word[max(a, marks[0]) : min(b, marks[-1])].sum()
    assert right / found > 0.95 and right / wanted > 0.95
    for open_ in ("<script ", "<!", "<a ", "<script>", "<"):  # 400 kB that never close a tag
        start = time.process_time()
        html_extract.tokens(open_ * (400_000 // len(open_)))
        assert time.process_time() - start < 5
    clash = spark.createDataFrame([(1, "<p>a b</p>", "x", 3)], "page_id long, html string, text string, n_words int")
    assert [tuple(r) for r in html_extract.extracted(clash).collect()] == [(1, "a b", 2)]


def test_columns_that_clash(spark, awkward):
    """Names that an operator could use inside change nothing, and come back where columns are kept."""
    from pyspark.sql import functions as F

    names = ["_host", "_lines", "_kept", "_digest", "_row", "_pages", "_hit", "_line", "one", "two", "size", "part", "rep", "name", "members", "links", "group", "block", "key", "bucket", "own", "again", "blocks", "digest", "row", "host_of_list", "boilerplate", "lines_left", "digest_of_text", "toxic", "rejected", "tokens", "places"]
    wide = awkward.select("*", *(F.lit("x").alias(n) for n in names))
    items = spark.createDataFrame([(1, "word0 word1 word2 word3 word4")], "item_id long, text string")
    marks = spark.createDataFrame([(4, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (
        language_id.identify, language_id.accepted, exact_dedup.copies, exact_dedup.without_copies, line_dedup.cleaned, byte_bpe.encoded, ngram_join.without_near_copies,
        lambda d: repeats.maximal(d).drop("longer"), lambda d: toxicity.scored(d, marks), lambda d: decontaminate.clean(d, items),
    ):
        plain, clashing = f(awkward), f(wide)
        assert plain.columns == [c for c in clashing.columns if c not in names or c in plain.columns]
        assert sorted(map(str, plain.collect())) == sorted(map(str, clashing.select(*plain.columns).collect()))


def test_stages_on_awkward_and_empty_tables(spark, awkward, empty):
    import corpus_pipeline

    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "byte_bpe" or rows.columns == docs.columns
            number = rows.count()
            assert number == docs.count() == 0 if docs is empty else 0 < number <= docs.count()


def test_pipeline_effects(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id for r in rows.collect()}
    texts = {}
    for r in docs:
        texts.setdefault(r.text, []).append(r.doc_id)
    assert all(len(ids & {*v}) <= 1 for v in texts.values()) and len(ids) > 0.7 * len(texts)
    assert rows.where("NOT intact").count() == 0


def test_stages_bound_what_python_workers_get(spark, empty):
    """Rows of 5 KB come in batches of about 1 MB, 10,000 rows of 2 KB being 20 MB; a lower bound of the session's stays."""
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    for name, stage in corpus_pipeline.STAGES:
        if name == "exact_dedup":  # has no Python workers
            continue
        for own in (None, "64k"):
            session = spark.newSession()
            if own:
                session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
            stage(session, session.createDataFrame([], empty.schema), "/root/testdata/sf0.001")
            met = session.range(0, 1000, 1, 1).selectExpr("repeat('x', 5000) AS text").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in met) == 1000 and max(r.size for r in met) < (80_000 if own else 1_200_000)


def test_language_id_scores_few_texts_at_once():
    """Texts of 1.2 MB are scored in runs, whose logits are those of each text alone."""
    rng = np.random.default_rng(3)
    model = language_id.Model(["de", "en"], rng.normal(size=(language_id.BUCKETS, 2)), np.array([0.1, -0.1]), unknown=np.zeros(language_id.BUCKETS))
    texts = ["".join(chr(x) for x in rng.integers(97, 123, 2000)) for _ in range(600)]
    runs = list(language_id.logits(model, pa.array(texts)))
    assert [i for i, *_ in runs] == np.cumsum([0, *(len(scores) for _, scores, *_ in runs)])[:-1].tolist() and sum(len(scores) for _, scores, *_ in runs) == 600
    assert max(len(scores) for _, scores, *_ in runs) * 2000 <= 1 << 18
    together = np.concatenate([scores for _, scores, *_ in runs])
    assert all(np.array_equal(together[k], next(language_id.logits(model, pa.array(texts[k : k + 1])))[1][0]) for k in range(0, 600, 97))


def test_local_tables_take_no_python_workers(spark):
    """As whole values of any type, without a Python stage in the plan."""
    from pyspark.sql.types import StructType

    from folio.llm.common import local

    for schema, columns in (("i int, s string", [[3, None, 1], ["a", "", None]]), ("i long", [[]]), ("d decimal(9,2)", [[None]])):
        table = local(spark, StructType.fromDDL(schema), *columns)
        assert table.schema == StructType.fromDDL(schema) and [tuple(r) for r in table.collect()] == list(zip(*columns))
        assert table._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"


def test_lists_with_known_groups_pair_across_them():
    rng = np.random.default_rng(8)
    group = np.array([-1, 0, 0, 0, 1, 1, -1, -1, 0, 0, 0, 2])
    who = np.concatenate([np.sort(rng.choice(12, k, replace=False)) for k in (12, 7, 3, 1, 9)] + [np.array([0, 6, 7]), np.array([1, 2, 3, 8, 9])])
    new = np.zeros(len(who), bool)
    new[np.cumsum([0, 12, 7, 3, 1, 9, 3])] = True
    run = np.cumsum(new)
    many = np.bincount(run)[run] - 1 - (np.arange(len(who)) - np.flatnonzero(new)[run - 1])
    left = many.copy()
    element, first, counts = ngram_join._across(who, group, new, left)
    asked = lambda i, j: group[who[i]] < 0 or group[who[i]] != group[who[j]]
    got = [(i, i + k) for i in range(len(who)) for k in range(1, left[i] + 1)]
    got += [tuple(sorted((int(element[i]), int(element[k])))) for i in range(len(element)) for k in range(first[i], first[i] + counts[i])]
    want = [(i, i + k) for i in range(len(who)) for k in range(1, many[i] + 1)]
    assert len(got) == len(set(got)) and {x for x in got if asked(*x)} == {x for x in want if asked(*x)} and len(got) < len(want)
    assert left[-5:].sum() == 0 and not {x for x in got if x[0] >= len(who) - 5}


def test_links_of_a_large_group_without_its_pairs_in_the_index(spark, monkeypatch):
    for name, value in (("FIRST_FROM", 1), ("SETS", 32), ("HELD", 64), ("INDEXED", 2000)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    rng, keep, made = random.Random(6), ngram_join.stored, []

    def counted(df, name):
        table = keep(df, name)
        if name == "pairs":
            made.append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "stored", counted)
    docs = []
    for i in range(150):
        w = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.choice((4, 14))):
            w[k] = f"x{i}y{k}"
        docs.append((i, " ".join(w)))
    docs += [(150 + i, docs[i][1]) for i in range(20)] + [(200 + i, t) for i, t in near_docs(rng, 60)]
    want = pairs_of(docs, ngram_join.WORDS, ngram_join.THRESHOLD)
    links = {i: sum(i in pair for pair in want) for i, _ in docs}
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.links for r in ngram_join.classes(frame_).collect()} == links
    assert sum(made) < 150 * 149 / 2 / 4
    assert {(r.id_a, r.id_b): r.jaccard for r in ngram_join.similar(frame_).collect()} == want
