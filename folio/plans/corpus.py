"""Queries over texts: tokens, overlap, vectors, lengths, filters, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import lexicons, text
from folio.operators import chunking, filters, overlap, statistics
from folio.sources.tables import table



def _docs(spark, d):
    return table(spark, d, "documents")


def tokenize_counts(spark, d):
    """Tokens, distinct tokens, plain words and white-space words of every document."""
    w = text.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).alias("tokens"), F.size(F.array_distinct(w)).alias("distinct_tokens"), F.size(text.plain_words(F.col("text"))).alias("plain"), F.size(text.parts(F.col("text"))).alias("words"))


def token_estimate(spark, d):
    """The three token estimates of every document."""
    return _docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("estimate"), text.stream_estimate(F.col("text")).alias("stream"), F.floor(F.length("text") / 4).cast("int").alias("quarter"))


def text_hash(spark, d):
    """Short hash and length of every document."""
    return _docs(spark, d).select("doc_id", text.short_hash(F.col("text")).alias("hash"), F.length("text").alias("length"))


def ngram_index_size(spark, d):
    """Distinct 8-grams of the benchmark."""
    return overlap.index(table(spark, d, "benchmark")).agg(F.count(F.lit(1)).alias("grams"))


def ngram_overlap(spark, d):
    """Share of every document's 8-grams that the benchmark has."""
    return overlap.overlap(_docs(spark, d), table(spark, d, "benchmark"))


def longest_match(spark, d):
    """Longest run of up to 8 tokens of every document that the benchmark has."""
    return overlap.longest_match(_docs(spark, d), table(spark, d, "benchmark"))


def vector_topk(spark, d):
    """The five nearest other vectors of every vector."""
    v = table(spark, d, "embeddings")
    return overlap.top_k(v, v)


def vector_top1_avg(spark, d):
    """Best and mean similarity of every vector's five nearest."""
    return vector_topk(spark, d).groupBy("query_id").agg(F.max("similarity").alias("top1"), F.round(F.avg("similarity"), 6).alias("top_avg"))


def similarity_gate(spark, d):
    """Gate of every document by its longest match and the nearest vector of its id."""
    match = longest_match(spark, d).join(vector_top1_avg(spark, d).select(F.col("query_id").alias("doc_id"), "top1"), "doc_id", "left")
    return overlap.gate(match, 8, 0.5).select("doc_id", "max_match", "top1", "fallback", "reason")


def length_distribution(spark, d):
    """Order statistics of the characters of all documents."""
    return statistics.distribution(_docs(spark, d).select(F.length("text").cast("long").alias("n_")), "n_")


def distribution_by_lang(spark, d):
    """Order statistics of the token estimates by language."""
    return statistics.distribution(_docs(spark, d).select("lang", text.token_estimate(F.col("text")).cast("long").alias("e")), "e", "lang")


def over_threshold(spark, d):
    """Documents beyond each token limit."""
    return statistics.over(_docs(spark, d).select(text.token_estimate(F.col("text")).alias("e")), "e")


def paragraph_filter(spark, d):
    """Lines of all documents that the paragraph filter keeps, with a reference list put into every fifth."""
    return filters.kept_paragraphs(filters.paragraphs(_sectioned(_docs(spark, d))), 12).select("doc_id", "pos", F.length("para").alias("length"))


def _sectioned(docs):
    """A reference heading of 12 words in the middle of every fifth document."""
    head = "References " + " ".join(f"entry{i}" for i in range(12))
    lines = F.split("text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    cut = F.array_join(F.concat(F.slice(lines, F.lit(1), half), F.array(F.lit(head)), F.slice(lines, half + 1, F.size(lines))), "\n")
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, cut).otherwise(F.col("text")).alias("text"))


REFERENCE = "Smith, A.B. (2018) Nature, 45, 123-456. Jones, C.D. (2019) Science, 12, 34-56. Brown et al. (2020) J. Bacteriol. 3:12-15. Miller, K. (2021) Proc. Natl Acad 10.1234/abc 10.5678/def"
ARTIFACT = " View Article Online  This journal is © The Royal Society of Chemistry 2019   DOI: 10.1039/c9np00001a www.rsc.org/npr Natural Product Reports"


def _cited(docs):
    """The reference text after every third document, the artifacts after every fourth."""
    return docs.select("doc_id", F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("\n" + REFERENCE)).otherwise(""), F.when(F.col("doc_id") % 4 == 0, F.lit(ARTIFACT)).otherwise("")).alias("text"))


def reference_scores(spark, d):
    """Points of both bibliography tests."""
    return _cited(_docs(spark, d)).select("doc_id", filters.bibliography_a(F.col("text")).alias("score_a"), filters.bibliography_b(F.col("text")).alias("score_b"))


def artifact_clean(spark, d):
    """Artifacts of every document, its length without them, and what becomes of it as a sample."""
    rows = _cited(_docs(spark, d)).select("doc_id", filters.artifacts(F.col("text")).cast("long").alias("artifacts"), F.length(filters.without_artifacts(F.col("text"))).alias("length"))
    return rows.select("*", filters.outcome(F.col("artifacts"), F.col("length")).alias("outcome"))


def sample_filter_accounting(spark, d):
    """Samples by outcome."""
    return artifact_clean(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 4).alias("mean_length"))


def section_detect(spark, d):
    """Section by the words of the opening; every seventh document is given one."""
    opening = F.when(F.col("doc_id") % 7 == 0, "Materials and methods: PCR was performed. ").when(F.col("doc_id") % 7 == 1, "Results. As shown in Figure 2, ").when(F.col("doc_id") % 7 == 2, "in this study, here we show that ").otherwise("")
    return _docs(spark, d).select("doc_id", filters.section(F.concat(opening, F.col("text"))).alias("section"))


def pair_candidates(spark, d):
    """Documents that may become style pairs."""
    return _docs(spark, d).where(filters.pair_candidate(F.col("text"))).select("doc_id")


def chunk_tokens(spark, d):
    """Word chunks of every document."""
    return chunking.pieces(_docs(spark, d), chunking.by_words(F.col("text"))).select("doc_id", "chunk", F.length("part").alias("length"))


def chunk_sentences(spark, d):
    """Sentence chunks of every document."""
    return chunking.pieces(_docs(spark, d), chunking.split_sentences(F.col("text"), 256, 40)).select("doc_id", "chunk", "part")


def chunk_lines(spark, d):
    """Chunks by the strategy of every document, its lines being paragraphs."""
    rows = _docs(spark, d).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.pieces(rows, chunking.by_strategy(F.col("text"), 256, 40)).select("doc_id", "chunk", "part")


def chunk_histogram(spark, d):
    """Documents by their number of word chunks."""
    return chunk_tokens(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")).groupBy("chunks").agg(F.count(F.lit(1)).alias("documents"))


def chunk_conversations(spark, d):
    """Packed turns of every conversation."""
    return chunking.conversations(table(spark, d, "conversations"), 128)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, token_estimate, text_hash, ngram_index_size, ngram_overlap, longest_match, vector_topk, vector_top1_avg, similarity_gate, length_distribution, distribution_by_lang, over_threshold,
        paragraph_filter, reference_scores, artifact_clean, sample_filter_accounting, section_detect, pair_candidates, chunk_tokens, chunk_sentences, chunk_lines, chunk_histogram, chunk_conversations,
    )
}


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
PLAIN = f"list_filter({TOKENS}, lambda w: regexp_full_match(w, '[a-z]+'))"
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}\x0B]"
PARTS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
ESTIMATE = f"CAST(trunc((len({PARTS}) * 1.3::DOUBLE + length(text) / 4.0::DOUBLE) / 2.0::DOUBLE) AS INTEGER)"


def _grams(n: int) -> str:
    gram = " || ' ' || ".join(f"w[p + {k}]" for k in range(n))
    return f"SELECT id, {gram} AS gram FROM (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS p FROM (SELECT id, w FROM src WHERE len(w) >= {n}))"


def _sources(n: int) -> str:
    return f"""d AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), b AS (SELECT item_id AS id, {TOKENS} AS w FROM benchmark),
g AS ({_grams(n).replace("src", "d")}), i AS (SELECT DISTINCT gram FROM ({_grams(n).replace("src", "b")}))"""


_LONGEST = f"""d AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), b AS (SELECT item_id AS id, {TOKENS} AS w FROM benchmark WHERE len({TOKENS}) >= 8),
m AS ({" UNION ALL ".join(f"SELECT DISTINCT id, {k} AS k FROM ({_grams(k).replace('src', 'd')}) WHERE gram IN (SELECT gram FROM ({_grams(k).replace('src', 'b')}))" for k in range(1, 9))}),
l AS (SELECT d.id AS doc_id, coalesce(max(m.k), 0) AS max_match FROM d LEFT JOIN m ON d.id = m.id GROUP BY d.id)"""
_TOP = """s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"""


def _distribution(rows: str, value: str, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    at = ", ".join(f"v[CAST(floor(n * {share}::DOUBLE) AS BIGINT) + 1] AS {name}" for name, share in statistics.SHARES)
    return f"SELECT {key}n, least, most, mean, {at} FROM (SELECT {key}count(*) AS n, min({value}) AS least, max({value}) AS most, round(avg({value}), 4) AS mean, list_sort(list({value})) AS v FROM ({rows}) {group})"


def _count(column: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({column}, {q(flags + pattern)}))"


def _points(tests: list, journals: list[str]) -> str:
    terms = []
    for pattern, steps in tests:
        n = _count("text", pattern)
        terms.append("CASE " + " ".join(f"WHEN {n} >= {least} THEN {points}" for least, points in steps) + " ELSE 0 END")
    if journals:
        terms.append("CASE WHEN " + " + ".join(_count("text", p) for p in journals) + " >= 3 THEN 1 ELSE 0 END")
    return f"CASE WHEN length(text) < 100 THEN 0 ELSE {' + '.join(terms)} END"




def _stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


_CITED = f"SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || {q(REFERENCE)} ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN {q(ARTIFACT)} ELSE '' END AS text FROM documents"
_clean = "text"
for _p in lexicons.ARTIFACTS:
    _clean = f"regexp_replace({_clean}, {q('(?i)' + _p)}, '', 'g')"
_clean = _stripped(f"regexp_replace({_clean}, '\\s{{3,}}', '  ', 'g')")
_hits = " + ".join(_count("text", p, "(?i)") for p in lexicons.ARTIFACTS)
_ARTIFACTS = f"""a AS (SELECT doc_id, CAST({_hits} AS BIGINT) AS artifacts, length({_clean}) AS length FROM ({_CITED})),
o AS (SELECT *, CASE WHEN artifacts > 3 THEN 'contaminated' WHEN length < 50 THEN 'too_short' WHEN length > 4000 THEN 'too_long' ELSE 'kept' END AS outcome FROM a)"""
_squeezed = f"trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))"
_sections = [(name, " + ".join(f"CAST(contains(h, {q(w)}) AS INTEGER)" for w in words)) for name, words in lexicons.SECTIONS]

_CHUNKS = f"SELECT doc_id, i // 384 AS chunk, length(array_to_string(w[greatest(i - 37, 0) + 1 : i + 384], ' ')) AS length FROM (SELECT doc_id, w, unnest(range(0, len(w), 384)) AS i FROM (SELECT doc_id, {PARTS} AS w FROM documents))"

ORACLES = {
    "tokenize_counts": f"SELECT doc_id, len({TOKENS}) AS tokens, len(list_distinct({TOKENS})) AS distinct_tokens, len({PLAIN}) AS plain, len({PARTS}) AS words FROM documents",
    "token_estimate": f"SELECT doc_id, {ESTIMATE} AS estimate, CASE WHEN text = '' THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS stream, length(text) // 4 AS quarter FROM documents",
    "text_hash": "SELECT doc_id, sha256(text)[1:16] AS hash, length(text) AS length FROM documents",
    "ngram_index_size": f"WITH {_sources(8)} SELECT count(*) AS grams FROM i",
    "ngram_overlap": f"""WITH {_sources(8)}, c AS (SELECT id, count(DISTINCT gram) AS grams, count(DISTINCT CASE WHEN gram IN (SELECT gram FROM i) THEN gram END) AS matching FROM g GROUP BY id)
SELECT d.id AS doc_id, coalesce(grams, 0) AS grams, coalesce(matching, 0) AS matching, coalesce(round(matching / grams, 6), 0.0) AS overlap_ratio FROM d LEFT JOIN c ON d.id = c.id""",
    "longest_match": f"WITH {_LONGEST} SELECT * FROM l",
    "vector_topk": f"WITH {_TOP} SELECT * FROM r WHERE rank <= 5",
    "vector_top1_avg": f"WITH {_TOP} SELECT query_id, max(similarity) AS top1, round(avg(similarity), 6) AS top_avg FROM r WHERE rank <= 5 GROUP BY query_id",
    "similarity_gate": f"""WITH {_LONGEST}, {_TOP} SELECT doc_id, max_match, similarity AS top1, max_match >= 8 OR coalesce(similarity >= 0.5, false) AS fallback,
concat_ws('; ', CASE WHEN max_match >= 8 THEN 'ngram match ' || max_match END, CASE WHEN similarity >= 0.5 THEN printf('embedding similarity %.2f', similarity) END) AS reason
FROM l LEFT JOIN (SELECT * FROM r WHERE rank = 1) ON doc_id = query_id""",
    "length_distribution": _distribution("SELECT length(text) AS n_ FROM documents", "n_"),
    "distribution_by_lang": _distribution(f"SELECT lang, {ESTIMATE} AS e FROM documents", "e", "lang"),
    "over_threshold": f"SELECT {', '.join(f'count(*) FILTER (e > {x}) AS over_{x}' for x in (512, 1024, 2048, 4096))}, round(count(*) FILTER (e > 1024) / count(*) * 100, 4) AS truncated_pct FROM (SELECT {ESTIMATE} AS e FROM documents)",
    "paragraph_filter": f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN l[1 : len(l) // 2] || [{q("References " + " ".join(f"entry{i}" for i in range(12)))}] || l[len(l) // 2 + 1 :] ELSE l END AS l FROM s),
p AS (SELECT doc_id, pos, {_squeezed} AS text FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS x FROM t)),
w AS (SELECT *, string_split(text, ' ') AS w FROM p WHERE text <> '' AND len(string_split(text, ' ')) >= 12),
c AS (SELECT *, max(CAST(regexp_matches(text, '(?i)^(references|bibliography)') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS cut FROM w)
SELECT doc_id, pos, length(text) AS length FROM c WHERE cut = 0 AND NOT regexp_matches(text, '(?i)^(figure|table|references|bibliography|[0-9]+\\.?\\s*$)')
AND ({_points(lexicons.BIBLIOGRAPHY_A, lexicons.JOURNALS_A)}) < 3 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9.,]+'))) <= 0.5 * len(w)""",
    "reference_scores": f"SELECT doc_id, {_points(lexicons.BIBLIOGRAPHY_A, lexicons.JOURNALS_A)} AS score_a, {_points(lexicons.BIBLIOGRAPHY_B, [])} AS score_b FROM ({_CITED})",
    "artifact_clean": f"WITH {_ARTIFACTS} SELECT * FROM o",
    "sample_filter_accounting": f"WITH {_ARTIFACTS} SELECT outcome, count(*) AS n, round(avg(length), 4) AS mean_length FROM o GROUP BY outcome",
    "section_detect": f"""WITH h AS (SELECT doc_id, lower(substr(CASE doc_id % 7 WHEN 0 THEN 'Materials and methods: PCR was performed. ' WHEN 1 THEN 'Results. As shown in Figure 2, ' WHEN 2 THEN 'in this study, here we show that ' ELSE '' END || text, 1, 300)) AS h FROM documents),
s AS (SELECT doc_id, [{", ".join(c for _, c in _sections)}] AS c FROM h), m AS (SELECT doc_id, list_max(c) AS m, list_position(c, list_max(c)) AS i FROM s)
SELECT doc_id, CASE WHEN m >= 2 OR (m >= 1 AND i = 3) THEN [{", ".join(q(n) for n, _ in _sections)}][i] END AS section FROM m""",
    "pair_candidates": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '^\\p{{L}}') AND contains(text, '. ') AND NOT contains(text, 'http') AND NOT contains(substr(text, 1, 20), '10.1') AND ({_points(lexicons.BIBLIOGRAPHY_B, [])}) < 3",
    "chunk_tokens": _CHUNKS,
    "chunk_histogram": f"SELECT chunks, count(*) AS documents FROM (SELECT doc_id, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY doc_id) GROUP BY chunks",
    "chunk_conversations": f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, {ESTIMATE} AS n FROM conversations),
f AS (SELECT conv_id, i, turn, n AS total, 0 AS part, n FROM t WHERE i = 1 UNION ALL
SELECT t.conv_id, t.i, t.turn, CASE WHEN f.total + t.n <= 128 THEN f.total + t.n ELSE t.n END, CASE WHEN f.total + t.n <= 128 THEN f.part ELSE f.part + 1 END, t.n FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, part, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(n) AS INTEGER) AS tokens FROM f GROUP BY conv_id, part""",
}
