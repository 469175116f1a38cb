"""Hand-computed cases of the operators outside `llm`, and sources, sinks and streams."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import chunking, filters, overlap, statistics, telemetry, trainset
from folio.sources import readers, writers
from folio.streaming import telemetry as streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()[0]


def test_tokens(spark):
    t = F.col("text")
    assert one(spark, text.tokens(t), "We observed a 2.5-fold increase") == ["we", "observed", "a", "2", "5", "fold", "increase"]
    assert one(spark, text.tokens(t), "Résumé naïve_1 café") == ["résumé", "naïve_1", "café"]
    assert one(spark, text.tokens(t), "") == [] and one(spark, text.plain_words(t), "abc a1 é b") == ["abc", "b"]
    assert one(spark, text.ngrams(text.tokens(t), 3), "a b c d") == ["a b c", "b c d"] and one(spark, text.ngrams(text.tokens(t), 3), "a b") == []
    assert one(spark, text.squeezed(t), " a \n\tb ") == "a b" and one(spark, text.token_estimate(t), "word " * 100) == 127
    assert one(spark, text.detector_sentences(t), "See Fig. 2 here. It is so! Ok? no") == ["See Fig. 2 here", "It is so"]


def test_overlap(spark):
    corpus = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight y"), (2, "nine ten"), (3, "too short"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.max_match for r in overlap.longest_match(docs, corpus).collect()} == {1: 8, 2: 2, 3: 0, 4: 0}
    assert {r.doc_id: (r.grams, r.matching, r.overlap_ratio) for r in overlap.overlap(docs, corpus).collect()} == {1: (3, 1, 0.333333), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}


def test_statistics(spark):
    rows = spark.createDataFrame([(v,) for v in range(1, 11)], "v long")
    r = statistics.distribution(rows, "v").first()
    assert (r.n, r.median, r.p90, r.p95, r.p99, r["mean"]) == (10, 6, 10, 10, 10, 5.5)
    assert statistics.over(rows, "v", (3, 5)).first().asDict() == {"over_3": 7, "over_5": 5, "truncated_pct": 50.0}


def packed(pieces, most, carry, glue):
    size = lambda s: int((len(s.split()) * 1.3 + len(s) / 4) / 2)
    done, now, n = [], [], 0
    for p in pieces:
        if size(p) > most:
            done += ([glue.join(now)] if now else []) + [p]
            now, n = [], 0
        elif n + size(p) <= most:
            now.append(p)
            n += size(p)
        else:
            last = now[-1] if now else None
            done += [glue.join(now)] if now else []
            now = [last, p] if last is not None and size(last) < carry else [p]
            n = sum(map(size, now))
    return done + ([glue.join(now)] if now else [])


@pytest.mark.parametrize("most,carry", [(20, 0), (20, 8), (60, 15)])
def test_chunking(spark, most, carry):
    sentences = [" ".join(f"W{i}x{k}" for k in range(1 + i * 7 % 23)) + "." for i in range(40)]
    body = " ".join(sentences)
    assert one(spark, chunking.by_sentence(F.col("text"), most, carry), body) == packed(sentences, most, carry, " ")
    assert one(spark, chunking.by_paragraph(F.col("text"), most, carry), "\n\n".join(sentences)) == packed(sentences, most, carry, "\n\n")
    whole = one(spark, chunking.by_words(F.col("text"), most, 0), body)
    assert " ".join(whole).split() == body.split() and one(spark, chunking.by_words(F.col("text"), most, 4), "") == []


def test_filters(spark):
    t = F.col("text")
    words = " ".join(f"word{i}" for i in range(25))
    rows = spark.createDataFrame([(1, f"{words}\nReferences {words}\n{words}\nshort"), (2, f"Figure 1 {words}\n{words}"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.pos) for r in filters.kept_paragraphs(filters.paragraphs(rows)).collect()} == {(1, 0), (2, 1)}
    assert one(spark, filters.artifacts(t), "View Article Online, view article online") == 2 and one(spark, filters.without_artifacts(t), " a View Article Online b ") == "a  b"
    assert one(spark, filters.section(t), "Materials and methods: primers") == "Methods" and one(spark, filters.section(t), "nothing") is None


def test_trainset(spark):
    rows = spark.range(101).withColumnRenamed("id", "doc_id")
    sizes = {r.split: r["count"] for r in trainset.split(rows, "doc_id").groupBy("split").count().collect()}
    assert sizes == {"train": 90, "val": 11}
    para = spark.createDataFrame([(1, i, f"p{i}") for i in range(6)] + [(2, 0, "q")], "doc_id long, pos int, para string")
    got = {(r.doc_id, r.first, r.n) for r in trainset.context_windows(para).collect()}
    assert got == {(1, 0, 3), (1, 2, 3), (1, 5, 1), (2, 0, 1)}


def test_telemetry(spark):
    lines = spark.createDataFrame([("Iter 5: Train loss 2.5, Learning Rate 1e-5, Tokens/sec 9.5, Peak mem 4.0 GB",), ("Iter 6: Val loss 1.5",), ("Peak mem 1 GB",)], "line string")
    assert [tuple(r) for r in telemetry.parsed(lines).orderBy("step").collect()] == [(5, "train", 2.5, 1e-5, 9.5, 4.0), (6, "eval", 1.5, None, None, None)]
    start = spark.createDataFrame([(1, 2, 4, 2048, 16)], "id int, eval_batch int, batch int, seq int, layers int")
    chain = [tuple(r)[2:] for r in telemetry.fallbacks(start).orderBy("attempt").collect()]
    assert chain == [(2, 4, 2048, 16), (1, 4, 2048, 16), (1, 2, 2048, 16), (1, 1, 2048, 16), (1, 1, 1024, 16), (1, 1, 512, 16), (1, 1, 512, 8), (1, 1, 512, 4)]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "paper.jsonl").write_text('{"text": "a", "doc_id": "d"}\n\nnot json\n{"doc_id": "e"}\n{"text": "b"}\n')
    assert sorted((r.text, r.doc_id, r.para_id) for r in readers.lenient(spark, str(folder)).collect()) == [("a", "d", "unknown"), ("b", "unknown", "unknown")]
    assert sorted((r.text, r.doc_id, r.para_id) for r in readers.numbered(spark, str(folder)).collect()) == [("a", "d", "p1"), ("b", "paper", "p5")]
    with pytest.raises(Exception):
        readers.strict(spark, str(folder / "paper.jsonl"), readers.CORPUS).collect()
    rows = spark.createDataFrame([(1, None), (2, "é")], "id int, x string")
    writers.jsonl(rows, str(tmp_path / "out"))
    lines = sorted(x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines())
    assert list(map(json.loads, lines)) == [{"id": 1, "x": None}, {"id": 2, "x": "é"}]
    assert writers.resumed(rows, str(tmp_path / "log"), ["id"]) == 2 and writers.resumed(rows, str(tmp_path / "log"), ["id"]) == 0
    pairs = spark.createDataFrame([("p", "c", "r", 1)], "prompt string, chosen string, rejected string, n int")
    assert json.loads(writers.preferences(pairs, "array").first()[0]) == [{"prompt": "p", "chosen": "c", "rejected": "r"}]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("hello")
    (tmp_path / "docs" / "b.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    assert {r.extension: r.invalid for r in readers.inventory(readers.listing(spark, str(tmp_path / "docs"))).collect()} == {"txt": 1, "pdf": 0}


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, float(10 - i)) for i in range(8)] + [("b", 3, 1.0)], "run string, step long, loss double")
    rows.repartition(3).write.json(str(tmp_path / "s"))
    got = {(r.run, r.step, r.loss) for r in streams.drained(streams.latest(streams.steps(spark, str(tmp_path / "s"), "run string, step long, loss double", 1)), "latest_step", "complete").collect()}
    assert got == {("a", 7, 3.0), ("b", 3, 1.0)}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.txt").write_text("Iter 5: Train loss 2.5\nnoise\n")
    assert [r.step for r in streams.drained(streams.lines(spark, str(tmp_path / "l")), "log_lines").collect()] == [5]


def test_queries_match_their_sql(spark):
    """Every registered query of the library has rows at the smallest scale, and SQL unless it can't."""
    duckdb = pytest.importorskip("duckdb")
    from folio.plans import registry

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in "customer orders part events documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"chunk_sentences", "chunk_lines"}
    for name, sql in registry.ORACLES.items():
        found = registry.QUERIES[name](spark, folder)
        want = con.execute(sql)
        assert sorted(found.columns) == sorted(x[0] for x in want.description), name
        names = sorted(found.columns)
        rows = [sorted(plain(r) for r in x) for x in ((tuple(r[c] for c in names) for r in found.collect()), (tuple(r[c] for c in names) for r in (dict(zip([x[0] for x in want.description], v)) for v in want.fetchall())))]
        assert rows[0] == rows[1], name


def plain(row):
    """A row as strings, numbers to six digits."""
    return tuple(str(v) if v is None or isinstance(v, (str, bool)) else f"{float(v):.6g}" if hasattr(v, "__float__") else str(v) for v in row)


def test_rest_stands_without_llm(tmp_path):
    """The library and the entry import where the subpackage and its pipeline are gone."""
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "folio"), tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0


def test_gate_writes_similarities_as_printf_does(spark):
    values = [0.565, 0.545, 0.625, 0.875, 0.515, 0.575, 0.995, 1.005, 2.5, 1234.565]
    rows = spark.createDataFrame([(i, 9, v) for i, v in enumerate(values)], "doc_id long, max_match int, top1 double")
    got = [r.reason for r in overlap.gate(rows, 8, 0.5).orderBy("doc_id").collect()]
    assert got == [f"ngram match 9; embedding similarity {v:.2f}" for v in values]


def test_top_k_of_ties_and_repeated_ids(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(150)] + [(3, [0.5] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = set()
    for i, v in vectors:
        near = sorted((-round(sum(a * b for a, b in zip(v, w)), 5), j) for j, w in vectors if j != i)[:5]
        want |= {(i, j, -s, rank + 1) for rank, (s, j) in enumerate(near) if i != 3}
    got = {tuple(r) for r in overlap.top_k(frame, frame, 5, 40).collect()}
    assert {r for r in got if r[0] != 3} == want and 3 not in {r[1] for r in got if r[0] == 3}
