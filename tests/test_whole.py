"""The whole of jobs that were once done in part, against plain Python."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import lexicons, text
from folio.operators import chunking, filters, stylometry, telemetry, trainset


def _size(s):
    return int((len(s.split()) * 1.3 + len(s) / 4) / 2)


def _words(s, most, carry):
    words, step, back = s.split(), int(most * 0.75), int(carry * 0.75)
    return [" ".join(words[max(0, i - back) if i else 0 : i + step]) for i in range(0, len(words), step)]


def _packed(pieces, most, carry, glue, further):
    done, now, n = [], [], 0
    for p in pieces:
        if _size(p) > most:
            done += ([glue.join(now)] if now else []) + further(p)
            now, n = [], 0
            continue
        if n + _size(p) > most:
            done += [glue.join(now)] if now else []
            now = now[-1:] if now and _size(now[-1]) < carry else []
            n = sum(map(_size, now))
        now.append(p)
        n += _size(p)
    return done + ([glue.join(now)] if now else [])


@pytest.mark.parametrize("most,carry", [(20, 0), (20, 8), (60, 15)])
def test_long_pieces_are_cut_further(spark, most, carry):
    draw = random.Random(most + carry)
    sentence = lambda i, n: " ".join(f"W{i}x{k}" for k in range(n)) + "."
    paragraphs = [[sentence(f"{p}y{i}", draw.choice((1, 3, 6, 14, 90))) for i in range(draw.randrange(1, 7))] for p in range(25)]
    split = lambda sentences: _packed(sentences, most, carry, " ", lambda s: _words(s, most, carry))
    flat = [s for p in paragraphs for s in p]
    inside = {" ".join(p): p for p in paragraphs}
    rows = spark.createDataFrame([(" ".join(flat), "\n\n".join(inside))], "flat string, blocks string")
    got = rows.select(chunking.split_sentences(F.col("flat"), most, carry), chunking.by_strategy(F.col("blocks"), most, carry), chunking.by_strategy(F.col("flat"), most, carry)).first()
    assert got[0] == split(flat) == got[2]
    assert got[1] == _packed(list(inside), most, carry, "\n\n", lambda p: split(inside[p]))
    assert max(_size(s) for s in flat) > most


def _pair_paragraphs(text, least=100, most=1500):
    def joined(pieces):
        now, out = "", []
        for p in pieces:
            if now and len(now) + len(p) + 1 > most:
                out.append(now)
                now = p
            else:
                now = f"{now} {p}" if now else p
        return out, now

    found = []
    for block in filter(None, (b.strip() for b in text.split("\n\n"))):
        if len(block) <= most:
            found.append(block)
            continue
        out, last = joined(filter(None, (x.strip() for x in block.split("\n"))))
        if len(last) > most:
            more, rest = joined(last.replace(". ", ".\n").split("\n"))
            out, last = out + more, rest
        found += [*out, last]
    return [x for x in found if len(x) >= least]


def test_alpaca_rows_are_chunks_without_reference_lists(spark):
    draw = random.Random(3)
    line = lambda n: " ".join(f"word{draw.randrange(99)}" + "." * (draw.random() < 0.1) for _ in range(n))
    texts = ["\n\n".join("\n".join(line(draw.choice((2, 30, 90, 400))) for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 6))) for _ in range(30)] + ["a" * 1500, "b" * 1501, "c. " * 600, "d" * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.chunk): r.text for r in trainset.paragraph_chunks(docs).collect()}
    want = {(i, k): x for i, t in enumerate(texts) if len(t) >= 100 for k, x in enumerate([t.strip()] if len(t.strip()) <= 1500 else _pair_paragraphs(t))}
    assert got == want and len(want) > 60
    listed = "Smith J. 2001. J. Bacteriol. Res. 4:1699-1708. Mol. Gen. Genet. 244:135-143. " * 2
    chunks = spark.createDataFrame([(i, 0, x) for i, x in enumerate(("plain " * 30, listed, "paired " * 30, "bad pair " * 30, "late " * 30))], "doc_id long, chunk int, text string")
    pairs = spark.createDataFrame([(1, "v1", 1, "g", "o"), (2, "v1", 1, "old", "o"), (2, "v1", 2, "new", "own"), (2, "v2", 3, "g2", "own2"), (3, "v1", 4, "g", listed), (3, "v2", 5, "g", "o"), (4, "v2", 6, "g", "o")], "doc_id long, variant string, line int, generic string, original string").withColumn("chunk", F.lit(0))
    rows = {(r.doc_id, r.variant): (r.input, r.output) for r in trainset.alpaca_chunks(chunks, pairs).collect()}
    assert rows == {(0, "none"): ("", "plain " * 30), (2, "v1"): ("new", "own"), (2, "v2"): ("g2", "own2"), (4, "none"): ("", "late " * 30)}


def _same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from folio.plans import registry

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found, want = registry.QUERIES[name](spark, folder), con.execute(registry.ORACLES[name])
    names = sorted(x[0] for x in want.description)
    place = [[x[0] for x in want.description].index(n) for n in names]
    rows = sorted(tuple(r[i] for i in place) for r in want.fetchall())
    assert sorted(found.columns) == names and sorted(map(tuple, found.select(*names).collect())) == rows and rows


def test_alpaca_chunks_match_their_sql(spark):
    _same_as_sql(spark, "alpaca_chunks")


def test_closeness_has_four_parts(spark):
    docs = spark.createDataFrame([(1, "However cells were treated slowly. We show them again here."), (2, "")], "doc_id long, text string")
    style = lambda *x: spark.createDataFrame([x], "mean_length double, deviation double, verbs array<string>, transitions array<string>, passive_ratio double")
    of = lambda *x: {r.doc_id: r.closeness for r in stylometry.closeness(docs, style(*x)).collect()}
    # sentences of 5 words each: 1; one of four verbs: 0.5; one of two transitions: 1; passive 1 / 2 against 0.25: 0.5
    assert of(5.0, 2.0, ["show", "a", "b", "c"], ["however", "thus"], 0.25) == {1: 0.75, 2: 0.167}
    assert of(5.0, 2.0, ["show", "a", "b", "c"], [], 0.0) == {1: 0.75, 2: 0.0}
    assert of(5.0, 0.0, [], [], 0.0) == {1: 0.5, 2: 0.5}


def test_style_closeness_matches_its_sql(spark):
    _same_as_sql(spark, "style_closeness")


def test_fallbacks_go_on_until_nothing_is_left(spark):
    start = spark.createDataFrame([(1, 64, 64, 2048, 16), (2, 1, 1, 512, 4)], "id int, eval_batch int, batch int, seq int, layers int")
    rows = telemetry.fallbacks(start).orderBy("id", "attempt").collect()
    chain = [tuple(r)[1:] for r in rows if r.id == 1]
    assert chain[-1] == (16, 1, 1, 512, 4) and chain[12] == (12, 1, 1, 2048, 16) and len(chain) == 17
    assert [tuple(r)[1:] for r in rows if r.id == 2] == [(0, 1, 1, 512, 4)]


def test_oom_fallback_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from folio.plans import registry

    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    rows = registry.QUERIES["oom_fallback"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(registry.ORACLES["oom_fallback"]).fetchall())


def test_scores_of_a_text_of_many_sentences_take_one_pass(spark):
    draw = random.Random(4)
    body = " ".join(" ".join(draw.choice(("cell", "growth", "rate", "x1", "naïve")) for _ in range(draw.randrange(1, 12))) + "." for _ in range(4000))
    lengths = [n for n in (sum(w.isascii() and w.isalpha() for w in s.split()) for s in body.rstrip(".").split(". ") if len(s.strip()) > 3) if n]
    mean = sum(lengths) / len(lengths)
    want = round((sum((n - mean) ** 2 for n in lengths) / len(lengths)) ** 0.5 / mean, 3)
    start = time.time()
    r = stylometry.scores(spark.createDataFrame([(1, body)], "doc_id long, text string")).first()
    assert abs(r.burstiness - want) < 0.0011 and time.time() - start < 60


def _perplexity(texts):
    pairs = [t.lower()[i : i + 2] for t in texts if len(t) >= 50 for i in range(len(t) - 1)]
    if not pairs:
        return 30.0
    return round(3.5 * 2 ** -sum(pairs.count(p) / len(pairs) * math.log2(pairs.count(p) / len(pairs)) for p in set(pairs)), 2)


def test_perplexity_makes_no_row_for_each_pair(spark):
    rows = [(1, "Añb 😀 cd " * 12), (2, "short"), (3, None), (4, "abcabd" * 20), (4, "xyzzy " * 15), (None, "w" * 80), (5, "q" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i or 0, 30.0 if i is None else _perplexity([t for k, t in rows if k == i and t])) for i, _ in rows)
    assert sorted((r.doc_id or 0, r.perplexity) for r in stylometry.perplexity(docs).collect()) == want
    plan = docs.where("doc_id = 1").transform(stylometry.perplexity)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_phrases_are_found_as_without_the_words_looked_for_first(spark):
    found = [
        "firstly, a secondly, b thirdly, c", "A WIDE ARRAY OF", "It Is Important To Note", "it is worth noting that", "IT SHOULD BE NOTED", "plays a vital role", "Additionally", "consequently", "FURTHERMORE", "moreover", "facilitates", "Leveraged", "utilized",
        "This journal is © The Royal Society of Chemistry 2019", "Nat Prod Rep", "natural product reports", "This article is licensed under a Creative Commons", "Downloaded by X y on 1/2/2019 1:02:03 AM.", "downloaded by Universiteit Leiden x.",
        "Downloaded by University of X.", "Published on 01 May 2019.", "View Article Online", "DOI: 10.1039/c9", "WWW.RSC.org/npr", "Who may suggest it. They Were analysed", None, "", "  x  ",
    ]
    docs, t = spark.createDataFrame([(x,) for x in found], "text string"), F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p))
    for got, patterns in ((filters.artifacts(t), lexicons.ARTIFACTS), (F.size(stylometry.pattern_issues(t)), [p for _, p, _ in lexicons.PATTERNS])):
        for r in docs.select(got.alias("got"), *(count("(?i)" + p).alias(f"p{i}") for i, p in enumerate(patterns))).collect():
            assert r.got in (None, sum(r[1:]), sum(x > 0 for x in r[1:])) if r[1] is not None else r.got in (None, 0)
    for fast, slow in ((stylometry.PASSIVE_FAST, stylometry.PASSIVE), (stylometry.HEDGE_FAST, stylometry.HEDGE)):
        assert all(r[0] == r[1] for r in docs.select(count(fast), count(slow)).collect())
    assert [r[0] for r in docs.select(text.stripped(t)).collect()][-1] == "x"
