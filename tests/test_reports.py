"""Reports, answers, prompts, reasons and vector search against values worked out by hand or brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import curation, feedback, overlap, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_phrases_equal_plain_python(spark):
    """Cut at the first of three marks whose packed parts all fit, else by words."""
    import re

    words = "alpha beta gamma delta and or but however one two three".split()
    rng = random.Random(4)
    sentences = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ";"]) for _ in range(rng.randint(1, 40))) for _ in range(120)] + ["", "word", "x, y", " ; "]
    parts = sorted({w for s in sentences for cut in (r";\s*", r",\s+(?=and|or|but|however|therefore|moreover)", r",\s*") for w in [*re.split(cut, s), s]})
    most = 12

    def estimates(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.token_estimate(F.col("t")).alias("n")).collect()
        return {r.t: r.n for r in rows}

    known = estimates({p.strip() for p in parts})
    packs = {}
    for s in sentences:
        for cut in (r";\s*", r",\s+(?=and|or|but|however|therefore|moreover)", r",\s*"):
            pieces = [p.strip() for p in re.split(cut, s)]
            if len(pieces) < 2:
                continue
            out, now, size = [], [], 0
            for p in filter(None, pieces):
                if size + known[p] > most and now:
                    out.append(" ".join(now))
                    now, size = [], 0
                now.append(p)
                size += known[p]
            packs.setdefault(s, []).append(out + ([" ".join(now)] if now else []))
    fits = estimates({c for x in packs.values() for p in x for c in p})
    want = {}
    for s in sentences:
        good = [p for p in packs.get(s, []) if p and all(fits[c] <= most for c in p)]
        w = s.split()
        want[s] = good[0] if good else [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
    rows = spark.createDataFrame([(s,) for s in sentences], "s string").select("s", curation.phrases(F.col("s"), most).alias("c")).collect()
    assert {r.s: r.c for r in rows} == want


def test_answers(spark):
    original = "0123456789" * 3
    cases = {"short": None, "Here is it:\n  " + original: original, "Sure,\nCondensed: now\n" + original: original, "Sure, " + original: "Sure, " + original, "y" * 200: "y" * 60, original: original}
    for given, want in cases.items():
        assert one(spark, curation.answer(F.lit(given), F.lit(original))) == want
    assert one(spark, curation.answer(F.lit("0123456"), F.lit(original), 0.2)) == "0123456"


def test_reasons(spark):
    issues = F.array(F.lit("uniform"), F.lit("starts"), F.lit("third"))
    assert one(spark, feedback.reason(F.lit("bad"), F.lit(0.75), issues)) == "user_marked_bad; high_ai_score(0.75); issues:uniform,starts"
    assert one(spark, feedback.reason(F.lit("ai_like"), F.lit(0.5))) == "user_marked_ai_like"
    assert one(spark, feedback.reason(F.lit("good"), F.lit(0.1))) == "unspecified"


def test_small_rules(spark):
    assert one(spark, reports.named_day(F.lit("run-lora-20260105-1"))) == "Jan 5" and one(spark, reports.named_day(F.lit("run-latest"))) == ""
    assert [one(spark, reports.safe_layers(F.lit(m), F.lit(10.0))) for m in (7.0, 7.1, 20.0, 100.0)] == [32, 28, 8, 4]
    assert [one(spark, reports.verdict(F.lit(g))) for g in (0.31, 0.2, -1.0)] == ["overfitting likely", "mild overfitting", "good generalization"]
    assert one(spark, curation.temperatures(F.lit(0.95), F.lit(0.2), F.lit(3))) == [0.75, 0.95, 1.0]
    assert one(spark, curation.strategies(F.lit(None).cast("array<string>"), F.lit(5))) == list("ABCD") and one(spark, curation.strategies(F.array(F.lit("C")), F.lit(2))) == ["C", "C"]
    assert one(spark, curation.first_half(F.lit("abcde"))) == "ab" and one(spark, curation.sentences_by_stop(F.lit("A. B.\nC"))) == ["A.", "B.", "C"]


def test_profiles_keep_every_row(spark):
    profiles = spark.createDataFrame([(2, "mac_b", 8.0, None), (1, "mac_a", 8.0, 16.0), (0, "other", None, None)], "place int, name string, low double, high double")
    rows = spark.createDataFrame([(1, 8.0), (1, 8.0), (2, 16.0), (3, 2.0), (4, None)], "id int, memory_gb double")
    assert sorted((r.id, r.profile) for r in reports.profile(rows, profiles).collect()) == [(1, "mac_a"), (1, "mac_a"), (2, "mac_b"), (3, "conservative"), (4, "conservative")]


def test_top_k_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (70, 4)).astype(float)  # many ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [0.0] * 4), (99, None)], "vec_id long, embedding array<double>")
    score = vectors @ vectors.T
    want = {(i, j, k + 1) for i in range(70) for k, j in enumerate(sorted((j for j in range(70) if j != i), key=lambda j: (-score[i, j], j))[:5])}
    for block in (4096, 9):
        assert {(r.query_id, r.vec_id, r["rank"]) for r in overlap.top_k(frame, frame, 5, block).collect()} == want
    assert overlap.top_k(frame.limit(0), frame).count() == 0
