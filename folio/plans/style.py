"""Queries of the stylometry of texts and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import lexicons
from folio.operators import stylometry
from folio.plans.corpus import PLAIN, SPACE, TOKENS, _count, q
from folio.sources.tables import table


def _prose(spark, d):
    """Documents with phrases of scientific prose put before every third, fourth and fifth."""
    c = F.col("doc_id")
    lead = F.concat(F.when(c % 3 == 0, F.lit(LEADS[0])).otherwise(""), F.when(c % 4 == 0, F.lit(LEADS[1])).otherwise(""), F.when(c % 5 == 0, F.lit(LEADS[2])).otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.concat(lead, F.col("text")).alias("text"))


LEADS = (
    "However, it is worth noting that samples were observed by Dr. Smith et al. in Fig. 2. ",
    "Furthermore, results may suggest that growth was measured; taken together, these results show a significant increase (Miller, 2019). ",
    "Although we utilize specifically strong methods, this might indicate an effect [12]. Is it new? ",
)


def char_perplexity(spark, d):
    """Character-pair perplexity of every document."""
    return stylometry.perplexity(table(spark, d, "documents"))


def ai_scores(spark, d):
    """All scores of every text."""
    return stylometry.scores(_prose(spark, d))


def risk_bands(spark, d):
    """Texts by risk."""
    return ai_scores(spark, d).groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def pattern_scores(spark, d):
    """Pattern score and issues of every text."""
    return _prose(spark, d).select("doc_id", F.round(stylometry.pattern_score(F.col("text")), 3).alias("score"), F.concat_ws(",", stylometry.pattern_issues(F.col("text"))).alias("issues"))


def style_metrics(spark, d):
    """Style measures of every text."""
    return stylometry.metrics(_prose(spark, d))


def style_scores(spark, d):
    """Style score and band of every text."""
    return stylometry.style_score(style_metrics(spark, d))


def fingerprint_sentences(spark, d):
    """Sentence statistics of the corpus."""
    return stylometry.sentence_stats(_prose(spark, d))


def fingerprint_vocabulary(spark, d):
    """Vocabulary statistics of the corpus."""
    return stylometry.vocabulary(_prose(spark, d))


def fingerprint_words(spark, d):
    """Favourite and avoided words of the corpus."""
    return stylometry.favourites(_prose(spark, d))


def fingerprint_structure(spark, d):
    """Structure statistics of the corpus."""
    return stylometry.structure(_prose(spark, d))


def fingerprint_openings(spark, d):
    """Most used sentence openings (a top-20 report)."""
    return stylometry.openings(_prose(spark, d))


def style_consistency(spark, d):
    """Closeness of every text to a fixed fingerprint."""
    return stylometry.consistency(_prose(spark, d), 12.0, 6.0, ["suggest", "indicate", "show", "observe"])


def style_closeness(spark, d):
    """Closeness of every text to the fingerprint of the corpus, in all four parts."""
    docs = _prose(spark, d)
    return stylometry.closeness(docs, stylometry.fingerprint(docs))


QUERIES = {f.__name__: f for f in (char_perplexity, ai_scores, risk_bands, pattern_scores, style_metrics, style_scores, fingerprint_sentences, fingerprint_vocabulary, fingerprint_words, fingerprint_structure, fingerprint_openings, style_consistency, style_closeness)}

_SRC = f"src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {q(LEADS[0])} ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN {q(LEADS[1])} ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN {q(LEADS[2])} ELSE '' END || text AS text FROM documents)"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _sentences(abbreviations: str, least: int) -> str:
    kept = f"regexp_replace(text, '\\b({abbreviations})\\.\\s', '\\1<DOT> ', 'g')"
    return f"list_transform(list_filter(string_split_regex({kept}, '[.!?]+\\s+'), lambda s: length({_strip('s')}) > {least}), lambda s: replace({_strip('s')}, '<DOT>', '.'))"


_DET, _FIN = _sentences(r"Dr|Mr|Mrs|Ms|Prof|et al|i\.e|e\.g|vs|etc|Fig|Eq", 3), _sentences(r"Dr|Mr|Mrs|Ms|Prof|et al|i\.e|e\.g|vs|etc", 5)
_WORDS = PLAIN.replace("lower(text)", "lower(s)")
_PPL = """c AS (SELECT doc_id, lower(text) AS t FROM {0} WHERE length(text) >= 50), g AS (SELECT doc_id, t[i : i + 1] AS p FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS i FROM c)),
k AS (SELECT doc_id, p, count(*)::DOUBLE AS k FROM g GROUP BY ALL), h AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM k GROUP BY doc_id),
ppl AS (SELECT {0}.doc_id, coalesce(round(3.5 * pow(2.0, h), 2), 30.0) AS perplexity FROM {0} LEFT JOIN h ON h.doc_id = {0}.doc_id)"""
_PATTERN = "least(1.0::DOUBLE, " + " + ".join(f"least({_count('text', p, '(?i)')}, 3) * {w}::DOUBLE" for _, p, w in lexicons.PATTERNS) + ")"
_ISSUES = ", ".join("CASE WHEN " + _count("text", p, "(?i)") + f" > 0 THEN {q(n)} END" for n, p, _ in lexicons.PATTERNS)
_SCORES = f"""{_SRC}, {_PPL.format("src")}, l AS (SELECT doc_id, text, {PLAIN} AS w, list_filter(list_transform({_DET}, lambda s: len({_WORDS})::DOUBLE), lambda n: n > 0) AS n FROM src),
m AS (SELECT doc_id, length({_strip("text")}) AS chars, len(w) AS words, round({_PATTERN}, 3) AS pattern,
 CASE WHEN len(n) < 3 THEN 0.35 ELSE round(list_stddev_pop(n) / list_avg(n), 3) END AS burstiness,
 CASE WHEN len(w) < 20 THEN 0.5 WHEN len(w) <= 100 THEN round(len(list_distinct(w)) / len(w), 3) ELSE round(list_avg(list_transform(range(0, len(w) - 99, 50), lambda i: len(list_distinct(w[i + 1 : i + 100])) / 100.0::DOUBLE)), 3) END AS diversity FROM l),
f AS (SELECT *, greatest(0.0, least(1.0, 1.0 - (perplexity - 15) / 45.0)) AS p, greatest(0.0, least(1.0, 1.0 - (burstiness - 0.25) / 0.2::DOUBLE)) AS b, greatest(0.0, least(1.0, 1.0 - (diversity - 0.4) / 0.3::DOUBLE)) AS v FROM m JOIN ppl USING (doc_id)),
s AS (SELECT doc_id, perplexity, burstiness, diversity, pattern, CASE WHEN chars < 50 THEN 0.5 ELSE round(0.25::DOUBLE * p + 0.3::DOUBLE * b + 0.2::DOUBLE * v + 0.15::DOUBLE * 0.5 + 0.1::DOUBLE * pattern, 3) END AS score,
 CASE WHEN chars < 50 THEN 0.2 ELSE round(0.4::DOUBLE * least(1.0, words / 200.0::DOUBLE) + 0.6::DOUBLE * greatest(0.3, 1.0 - 2.0 * (pow(p - (p + b + v) / 3, 2) + pow(b - (p + b + v) / 3, 2) + pow(v - (p + b + v) / 3, 2)) / 3), 3) END AS confidence FROM f),
r AS (SELECT *, score > 0.5 AS likely, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'moderate' WHEN score < 0.75 THEN 'high' ELSE 'very_high' END AS risk FROM s)"""


def _in(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{', '.join(map(q, words))}], x)))"


_METRICS = f"""{_SRC}, c AS (SELECT doc_id, text, {PLAIN} AS w, list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {_strip('s')}), lambda s: s <> ''), lambda s: len({TOKENS.replace("lower(text)", "lower(s)")})::DOUBLE) AS s FROM src WHERE length(text) >= 50),
m AS (SELECT doc_id, round(list_avg(s), 4) AS sentence_mean, CAST(list_max(s) AS BIGINT) AS sentence_max, round(list_var_pop(s), 4) AS sentence_variance, round(len(list_distinct(w)) / len(w), 4) AS richness,
 {", ".join(f"round({_in(ws)} / len(w) * 100, 4) AS {n}" for n, ws in (("discourse", lexicons.DISCOURSE), ("subordination", lexicons.SUBORDINATORS), ("hedging", lexicons.HEDGES), ("precision", lexicons.PRECISION)))},
 len(list_filter(range(1, len(w)), lambda i: list_contains([{", ".join(map(q, lexicons.AUXILIARIES))}], w[i]) AND list_contains([{", ".join(map(q, lexicons.PASSIVE_VERBS))}], w[i + 1]))) AS passive,
 {" + ".join(f"CAST(contains(lower(text), {q(p)}) AS BIGINT)" for p in lexicons.PHRASES)} AS transitions, len(w) AS words, len(s) AS sentences FROM c WHERE len(w) > 0 AND len(s) > 0)"""
_band = lambda x, steps: "CASE " + " ".join(f"WHEN {x} >= {a} THEN {p}" for a, p in steps) + f" WHEN {x} > 0 THEN 5 ELSE 0 END"
_FAV = [("verbs", lexicons.VERBS, 15), ("adjectives", lexicons.ADJECTIVES, 15), ("transitions", lexicons.TRANSITIONS, 10), ("avoided", lexicons.AVOIDED, 99)]
_ALL = f"x AS (SELECT unnest({PLAIN}) AS w FROM src)"

ORACLES = {
    "char_perplexity": f"WITH {_PPL.format('documents')} SELECT * FROM ppl",
    "ai_scores": f"WITH {_SCORES} SELECT * FROM r",
    "risk_bands": f"WITH {_SCORES} SELECT risk, count(*) AS n, round(avg(score), 4) AS mean_score FROM r GROUP BY risk",
    "pattern_scores": f"WITH {_SRC} SELECT doc_id, round({_PATTERN}, 3) AS score, concat_ws(',', {_ISSUES}) AS issues FROM src",
    "style_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "style_scores": f"""WITH {_METRICS}, t AS (SELECT doc_id, CAST(CASE WHEN sentence_mean BETWEEN 20 AND 30 THEN 20 WHEN sentence_mean BETWEEN 15 AND 35 THEN 10 WHEN sentence_mean > 10 THEN 5 ELSE 0 END
 + {_band("discourse", [(1.0, 20), (0.5, 15), (0.2, 10)])} + {_band("subordination", [(4.0, 20), (3.0, 15), (2.0, 10)])} + CASE WHEN hedging BETWEEN 0.5 AND 2 THEN 15 WHEN hedging BETWEEN 0.2 AND 3 THEN 10 WHEN hedging > 0 THEN 5 ELSE 0 END
 + {_band("precision", [(0.5, 15), (0.2, 10)])} + CASE WHEN transitions >= 2 THEN 10 WHEN transitions >= 1 THEN 5 ELSE 0 END AS BIGINT) AS style_score FROM m)
SELECT *, CASE WHEN style_score >= 70 THEN 'high' WHEN style_score >= 40 THEN 'medium' ELSE 'low' END AS band FROM t""",
    "fingerprint_sentences": f"""WITH {_SRC}, x AS (SELECT len({_WORDS}) AS n FROM (SELECT unnest({_FIN}) AS s FROM src)) SELECT count(*) AS sentences, round(avg(n), 1) AS mean_length, min(n) AS least, max(n) AS most, round(stddev_pop(n), 1) AS deviation,
round(avg(CAST(n < 10 AS INTEGER)), 3) AS short, round(avg(CAST(n BETWEEN 10 AND 25 AS INTEGER)), 3) AS middle, round(avg(CAST(n > 25 AS INTEGER)), 3) AS long FROM x WHERE n > 0""",
    "fingerprint_vocabulary": f"WITH {_SRC}, {_ALL} SELECT count(*) AS words, round(count(DISTINCT w) / count(*), 3) AS unique_ratio, round(avg(length(w)), 2) AS mean_length FROM x",
    "fingerprint_words": f"""WITH {_SRC}, {_ALL}, u AS (SELECT w, count(*) AS uses FROM x GROUP BY w), l(list, word, top) AS (VALUES {", ".join(f"({q(n)}, {q(w)}, {t})" for n, ws, t in _FAV for w in ws)}),
y AS (SELECT list, word, top, coalesce(uses, 0) AS uses FROM l LEFT JOIN u ON u.w = l.word), z AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY uses DESC, word) AS rank FROM y WHERE (uses > 0) <> (list = 'avoided')) SELECT list, word, uses, rank FROM z WHERE rank <= top""",
    "fingerprint_structure": f"""WITH {_SRC}, x AS (SELECT {_FIN} AS s, text, {PLAIN} AS w FROM src), y AS (SELECT len(s) AS s, len(list_filter(s, lambda x: regexp_matches(x, '(?i)\\b(was|were|been|being|is|are)\\s+[\\p{{L}}\\p{{N}}_]+ed\\b'))) AS p, len(list_filter(s, lambda x: contains(x, '?'))) AS qn,
 {_count("text", stylometry.HEDGE[4:], "(?i)")} AS h, len(w) AS w, CAST(regexp_matches(text, '\\([A-Z][a-z]+(\\s+(et al\\.)?)?,?\\s*[0-9]{{4}}\\)') AS INTEGER) AS a, CAST(regexp_matches(text, '\\[[0-9]+\\]') AS INTEGER) AS b FROM x)
SELECT round(sum(p) / sum(s), 3) AS passive_ratio, round(sum(qn) / sum(s), 3) AS question_ratio, round(sum(h) / sum(w) * 100, 2) AS hedges, CASE WHEN sum(a) = 0 AND sum(b) = 0 THEN 'unknown' WHEN sum(a) >= sum(b) THEN 'author_year' ELSE 'numbered' END AS citations, round(avg(s), 1) AS sentences FROM y""",
    "fingerprint_openings": f"""WITH {_SRC}, x AS (SELECT list_filter(string_split_regex(s, '{SPACE}+'), lambda w: w <> '') AS w FROM (SELECT unnest({_FIN}) AS s FROM src)), u AS (SELECT lower(array_to_string(w[1:3], ' ')) AS phrase, count(*) AS uses FROM x WHERE len(w) >= 3 GROUP BY 1 HAVING count(*) > 2)
SELECT phrase, uses, row_number() OVER (ORDER BY uses DESC, phrase) AS rank FROM u ORDER BY uses DESC, phrase LIMIT 20""",
    "style_consistency": f"""WITH {_SRC}, x AS (SELECT doc_id, list_transform({_DET}, lambda s: len({_WORDS})::DOUBLE) AS n, {PLAIN} AS w FROM src), y AS (SELECT doc_id, CASE WHEN len(n) > 0 THEN greatest(0.0, 1.0 - abs(list_avg(n) - 12.0) / 12.0) END AS a,
 least(1.0, len(list_intersect(list_distinct(w), ['suggest', 'indicate', 'show', 'observe'])) / 4.0::DOUBLE * 2) AS b FROM x) SELECT doc_id, round((coalesce(a, 0.0) + b) / (CASE WHEN a IS NULL THEN 1 ELSE 2 END), 3) AS consistency FROM y""",
}

_overlap = lambda words: f"CASE WHEN len({words}) > 0 THEN least(1.0::DOUBLE, len(list_intersect(w, {words})) / len({words})::DOUBLE * 2) END"
ORACLES["style_closeness"] = f"""WITH {_SRC}, fs AS ({ORACLES["fingerprint_sentences"]}), fw AS ({ORACLES["fingerprint_words"]}), ft AS ({ORACLES["fingerprint_structure"]}),
fp AS (SELECT mean_length, deviation, passive_ratio, (SELECT coalesce(list(word), []) FROM fw WHERE list = 'verbs') AS verbs, (SELECT coalesce(list(word), []) FROM fw WHERE list = 'transitions') AS transitions FROM fs, ft),
x AS (SELECT doc_id, list_transform({_DET}, lambda s: len({_WORDS})::DOUBLE) AS n, list_distinct({PLAIN}) AS w, {_count("text", stylometry.PASSIVE[4:], "(?i)")} AS p FROM src),
y AS (SELECT doc_id, list_filter([CASE WHEN len(n) > 0 AND deviation > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(list_sum(n) / len(n) - mean_length) / (deviation * 2)) END, {_overlap("verbs")}, {_overlap("transitions")},
 CASE WHEN passive_ratio > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(p / greatest(len(n), 1)::DOUBLE - passive_ratio) * 2) END], lambda v: v IS NOT NULL) AS parts FROM x, fp)
SELECT doc_id, CASE WHEN len(parts) = 0 THEN 0.5 ELSE round(list_sum(parts) / len(parts), 3) END AS closeness FROM y"""
