"""Queries of training sets, feedback and telemetry, derived from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import lexicons
from folio.operators import feedback, filters, telemetry, trainset
from folio.plans.corpus import REFERENCE, SPACE, _points, q
from folio.sources.tables import table


def weighted_corpus(spark, d):
    """Copies of the documents by weight: every tenth has priority, every seventh a weight, every thirteenth is excluded."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 == 0).alias("is_priority"))
    weights = docs.where("doc_id % 7 = 0").select("doc_id", (F.lit(0.5) + F.col("doc_id") % 4).alias("weight"))
    return trainset.weighted(docs, weights, docs.where("doc_id % 13 = 0").select("doc_id"))


def _pairs(docs):
    one = docs.where("doc_id % 2 = 0").select("doc_id", F.lower("text").alias("generic"), F.lit("v1").alias("variant"), F.lit(1).alias("line"))
    two = docs.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("> "), "text").alias("generic"), F.lit("v2").alias("variant"), F.lit(2).alias("line"))
    again = docs.where("doc_id % 6 = 0").select("doc_id", F.reverse("text").alias("generic"), F.lit("v1").alias("variant"), F.lit(3).alias("line"))
    return one.unionByName(two).unionByName(again)


def alpaca_build(spark, d):
    """Instruction rows of the documents and pairs derived from them."""
    docs = table(spark, d, "documents")
    rows = trainset.alpaca(docs, _pairs(docs))
    return rows.select("doc_id", "variant", F.length("input").alias("input_length"), F.md5("input").alias("input"), F.length("output").alias("output_length"))


def alpaca_chunks(spark, d):
    """Instruction rows of the chunks of documents, without reference lists, and pairs derived from the chunks; every tenth document's v1 have a reference list as original."""
    chunks = trainset.paragraph_chunks(table(spark, d, "documents"))
    c, t = F.col("doc_id"), F.col("text")
    pair = lambda every, variant, line, generic: F.when(c % every == 0, F.struct(F.lit(variant).alias("variant"), F.lit(line).alias("line"), generic.alias("generic")))
    made = F.filter(F.array(pair(2, "v1", 1, F.lower(t)), pair(4, "v2", 2, F.concat(F.lit("> "), t)), pair(6, "v1", 3, F.reverse(t)), pair(5, "v3", 4, F.upper(t))), lambda x: x.isNotNull())
    original = F.when((c % 10 == 0) & (F.col("p.variant") == "v1"), F.concat(t, F.lit("\n" + REFERENCE))).otherwise(t)
    pairs = chunks.withColumn("p", F.explode(made)).select("doc_id", "chunk", "p.*", original.alias("original"))
    rows = trainset.alpaca_chunks(chunks, pairs)
    return rows.select("doc_id", "chunk", "variant", F.length("input").alias("input_length"), F.md5("input").alias("input"), F.length("output").alias("output_length"), F.md5("output").alias("output"))


def sharegpt_build(spark, d):
    """Turns of every conversation as one text."""
    rows = trainset.sharegpt(table(spark, d, "conversations"))
    return rows.select("conv_id", F.size("conversations").alias("turns"), F.concat_ws("|", F.transform("conversations", lambda x: F.concat(x["from"], F.lit(":"), x["value"]))).alias("joined"))


def completion_build(spark, d):
    """Texts of 100 characters or more."""
    return trainset.completion(table(spark, d, "documents"))


def contrastive_build(spark, d):
    """Rows for contrastive training."""
    return trainset.contrastive(table(spark, d, "documents")).select("doc_id", F.length("chosen").alias("chosen"), "rejected", (F.col("input") == F.col("chosen")).alias("same"))


def context_windows(spark, d):
    """Windows of three lines of every document."""
    rows = trainset.context_windows(filters.paragraphs(table(spark, d, "documents")))
    return rows.select("doc_id", "first", "n", F.md5("context").alias("context"))


def train_val_split(spark, d):
    """Documents in each part of the split."""
    return trainset.split(table(spark, d, "documents").select("doc_id"), "doc_id", (("train", 0.9), ("val", 0.95), ("test", 1.0))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _sessions(spark, d):
    """Sessions of four documents each; labels give the kinds of feedback."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where("doc_id IS NOT NULL")
    kind = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "best").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 1), "edited").when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "ai_like").when(F.col("quality") == 0, "bad").otherwise("unrated")
    text = F.md5("text")
    variant = F.struct((F.col("doc_id") % 4).alias("pos"), kind.alias("feedback_type"), text.alias("text"), F.when(kind == "edited", F.concat(text, F.lit("*"))).otherwise("").alias("edited"), (F.col("doc_id") % 10 / 10.0).alias("ai_score"))
    key = F.floor(F.col("doc_id") / 4)
    return rows.groupBy(key.alias("session_id")).agg(F.array_sort(F.collect_list(variant)).alias("variants")).withColumn("input_text", F.when(F.col("session_id") % 5 == 0, "").otherwise(F.concat(F.lit("input "), F.col("session_id"))))


def feedback_stats(spark, d):
    """Counts of sessions, variants and kinds."""
    return feedback.stats(_sessions(spark, d))


def dpo_pairs_service(spark, d):
    """Preferred with rejected texts of every session."""
    return feedback.pairs(_sessions(spark, d))


def dpo_pairs_basic(spark, d):
    """Last best and last bad text of every session."""
    return feedback.last_pair(_sessions(spark, d))


def dpo_pairs_script(spark, d):
    """Preferred with bad texts of the sessions with an input."""
    return feedback.scripted_pairs(_sessions(spark, d))


def _steps(spark, d):
    """Events as steps: a run for each type."""
    return table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("user_id") % 50).cast("double").alias("speed"), (F.col("event_id") % 7).cast("double").alias("memory"))


def loss_summary(spark, d):
    """Summary of every run."""
    return telemetry.summary(_steps(spark, d))


def moving_avg_partial(spark, d):
    """Trailing means of every run."""
    return telemetry.trailing(_steps(spark, d))


def moving_avg_valid(spark, d):
    """Means of whole windows of every run."""
    return telemetry.whole_windows(_steps(spark, d))


def running_best(spark, d):
    """Least loss so far of every run."""
    return telemetry.running_best(_steps(spark, d))


def step_sample(spark, d):
    """Sixty evenly spaced steps of every run (a sampling operator)."""
    return telemetry.sampled(_steps(spark, d))


def log_parse(spark, d):
    """Log lines written from the events, and parsed."""
    e = table(spark, d, "events")
    train = F.format_string("Iter %d: Train loss %.3f, Learning Rate 1.000e-05, It/sec 2.5, Tokens/sec %.1f, Peak mem %.1f GB", "event_id", "value", F.col("user_id").cast("double"), (F.col("event_id") % 9).cast("double"))
    line = F.when(F.col("event_id") % 5 == 0, F.format_string("Iter %d: Val loss %.3f, Val took 1.0s", "event_id", "value")).when(F.col("event_id") % 5 == 1, "Saved adapter weights").when(F.col("event_id") % 5 == 2, F.concat(F.format_string("Iter %d: Train loss %.3f, ", "event_id", "value"), F.lit("Peak mem 2048.0 MB"))).otherwise(train)
    return telemetry.parsed(e.select(line.alias("line")))


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("base"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("loss"))


def registry_latest(spark, d):
    """The latest run of every base."""
    return telemetry.latest(_runs(spark, d), "base").select("run", "base", "recommended")


def run_listing(spark, d):
    """The ten latest runs (a top-k report)."""
    return _runs(spark, d).orderBy(F.desc("started_at"), F.desc("run")).limit(10).select("run", "base")


def memory_tier(spark, d):
    """Orders by price tier, a range join."""
    tiers = spark.createDataFrame([(0.0, 50000.0, "small"), (50000.0, 150000.0, "medium"), (150000.0, 1e12, "large")], "low double, high double, name string")
    return telemetry.tier(_runs(spark, d), tiers, "loss").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 2).alias("mean_price"))


def plan_scores(spark, d):
    """The plans that fit into 16 GB, ranked."""
    return telemetry.plans(spark).select("seq", "batch", "accum", "rank", "memory_gb", "effective", "score", "place")


def oom_fallback(spark, d):
    """Fallback chain of every part's configuration."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    return telemetry.fallbacks(p.select(F.col("p_partkey").alias("id"), (1 + size % 3).cast("int").alias("eval_batch"), (1 + size % 5).cast("int").alias("batch"), (512 + 256 * (size % 7)).cast("int").alias("seq"), (4 + size % 29).cast("int").alias("layers")))


QUERIES = {
    f.__name__: f
    for f in (
        weighted_corpus, alpaca_build, alpaca_chunks, sharegpt_build, completion_build, contrastive_build, context_windows, train_val_split, feedback_stats, dpo_pairs_service, dpo_pairs_basic, dpo_pairs_script, loss_summary,
        moving_avg_partial, moving_avg_valid, running_best, step_sample, log_parse, registry_latest, run_listing, memory_tier, plan_scores, oom_fallback,
    )
}

_STRIPPED = f"regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')"
_STEPS = "s AS (SELECT event_type AS run, event_id AS step, value AS loss, CAST(user_id % 50 AS DOUBLE) AS speed, CAST(event_id % 7 AS DOUBLE) AS memory FROM events)"
_SESSIONS = """v AS (SELECT doc_id // 4 AS session_id, doc_id % 4 AS pos, doc_id % 10 / 10.0::DOUBLE AS ai_score, md5(text) AS text, CASE WHEN (doc_id // 4) % 5 = 0 THEN '' ELSE 'input ' || (doc_id // 4) END AS input_text,
 CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'best' WHEN quality = 1 AND doc_id % 3 = 1 THEN 'edited' WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'ai_like' WHEN quality = 0 THEN 'bad' ELSE 'unrated' END AS kind FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT *, CASE WHEN kind = 'edited' THEN text || '*' ELSE text END AS t FROM v)"""


def _joined(pieces: str) -> str:
    return f"list_reduce({pieces}, lambda s, x: CASE WHEN len(s) > 0 AND length(s[len(s)]) + length(x) + 1 <= 1500 THEN list_append(s[1 : len(s) - 1], s[len(s)] || ' ' || x) ELSE list_append(s, x) END, []::VARCHAR[])"


def _stripped(x: str) -> str:
    return _STRIPPED.replace("text", x)


_lines = _joined(f"list_filter(list_transform(string_split(b, chr(10)), lambda y: {_stripped('y')}), lambda y: y <> '')")
_PIECES = f"""t AS (SELECT doc_id, {_STRIPPED} AS text FROM documents), b AS (SELECT doc_id, text, i, {_stripped("b")} AS b FROM (SELECT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS b FROM (SELECT doc_id, text, CASE WHEN length(text) <= 1500 THEN [text] ELSE string_split(text, chr(10) || chr(10)) END AS l FROM t WHERE length(text) >= 100))),
g AS (SELECT doc_id, i, CASE WHEN length(b) <= 1500 THEN [b] ELSE {_lines} END AS g FROM b WHERE b <> ''),
h AS (SELECT doc_id, i, CASE WHEN length(g[len(g)]) <= 1500 THEN g ELSE list_concat(g[1 : len(g) - 1], {_joined("string_split(replace(g[len(g)], '. ', '.' || chr(10)), chr(10))")}) END AS g FROM g),
u AS (SELECT doc_id, i, unnest(range(len(g))) AS j, unnest(g) AS text FROM h),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS chunk, text FROM u WHERE length(text) >= 100)"""
_memory = "round(4.0 + batch * seq * (4096.0::DOUBLE * 32 * 2) / 1073741824.0 + rank * (4096.0::DOUBLE * 32 * 2 * 2) / 1073741824.0, 4)"

ORACLES = {
    "weighted_corpus": """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2.5 WHEN doc_id % 7 = 0 THEN 0.5 + doc_id % 4 ELSE 1.0 END::DOUBLE AS weight FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CAST(unnest(range(1, CAST(greatest(1, trunc(weight)) AS BIGINT) + 1)) AS INTEGER) AS copy, weight FROM w""",
    "alpaca_build": f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN reverse(text) ELSE lower(text) END AS generic, 'v1' AS variant FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '> ' || text, 'v2' FROM documents WHERE doc_id % 4 = 0)
SELECT d.doc_id, coalesce(variant, 'none') AS variant, length(coalesce(generic, '')) AS input_length, md5(coalesce(generic, '')) AS input, length(text) AS output_length FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id WHERE length({_STRIPPED}) >= 100""",
    "alpaca_chunks": f"""WITH {_PIECES}, n AS (SELECT doc_id, chunk, text, {_points(lexicons.BIBLIOGRAPHY_B, [])} AS points FROM k),
o AS (SELECT doc_id, chunk, {_points(lexicons.BIBLIOGRAPHY_B, [])} AS original_points FROM (SELECT doc_id, chunk, text || chr(10) || {q(REFERENCE)} AS text FROM k WHERE doc_id % 10 = 0)),
c AS (SELECT n.*, text || CASE WHEN doc_id % 10 = 0 THEN chr(10) || {q(REFERENCE)} ELSE '' END AS original FROM n LEFT JOIN o USING (doc_id, chunk) WHERE points < 3 AND coalesce(original_points, 0) < 3),
r AS (SELECT doc_id, chunk, 'none' AS variant, '' AS input, text AS output FROM c WHERE doc_id % 2 <> 0 AND doc_id % 6 <> 0 UNION ALL SELECT doc_id, chunk, 'v1', CASE WHEN doc_id % 6 = 0 THEN reverse(text) ELSE lower(text) END, original FROM c WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, chunk, 'v2', '> ' || text, text FROM c WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, chunk, 'v3', upper(text), text FROM c WHERE doc_id % 2 = 0 AND doc_id % 5 = 0)
SELECT doc_id, chunk, variant, length(input) AS input_length, md5(input) AS input, length(output) AS output_length, md5(output) AS output FROM r""",
    "sharegpt_build": "SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ':' || text, '|' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id",
    "completion_build": f"SELECT doc_id, {_STRIPPED} AS text FROM documents WHERE length({_STRIPPED}) >= 100",
    "contrastive_build": f"SELECT doc_id, length({_STRIPPED}) AS chosen, '' AS rejected, true AS same FROM documents WHERE length({_STRIPPED}) >= 100",
    "context_windows": f"""WITH l AS (SELECT doc_id, pos, trim(regexp_replace(x, '{SPACE}+', ' ', 'g')) AS para FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
g AS (SELECT doc_id, list(para ORDER BY pos) AS w FROM l WHERE para <> '' GROUP BY doc_id), c AS (SELECT *, CASE WHEN len(w) < 3 THEN 0 ELSE (len(w) - 3) // 2 * 2 + 3 END AS covered FROM g)
SELECT doc_id, i AS first, CASE WHEN i % 2 = 0 AND i + 3 <= len(w) THEN 3 ELSE 1 END AS n, md5(CASE WHEN i % 2 = 0 AND i + 3 <= len(w) THEN array_to_string(w[i + 1 : i + 3], chr(10) || chr(10)) ELSE w[i + 1] END) AS context
FROM (SELECT *, unnest(range(0, len(w))) AS i FROM c) WHERE (i % 2 = 0 AND i + 3 <= len(w)) OR i >= covered""",
    "train_val_split": """WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'train' AS split, CAST(floor(n * 0.9::DOUBLE) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.95::DOUBLE) - floor(n * 0.9::DOUBLE) AS BIGINT) FROM n UNION ALL SELECT 'test', CAST(n - floor(n * 0.95::DOUBLE) AS BIGINT) FROM n""",
    "feedback_stats": f"WITH {_SESSIONS} SELECT count(DISTINCT session_id) AS sessions, count(*) AS variants, {', '.join(f'count(*) FILTER (kind = {q(k)}) AS {k}' for k in feedback.KINDS)} FROM t",
    "dpo_pairs_service": f"""WITH {_SESSIONS}, g AS (SELECT DISTINCT session_id, t AS chosen FROM t WHERE kind IN ('edited', 'best') OR (kind = 'good' AND ai_score < 0.4)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, t ORDER BY CASE kind WHEN 'bad' THEN 0 WHEN 'ai_like' THEN 1 ELSE 2 END, pos) AS r FROM t WHERE kind IN ('bad', 'ai_like') OR (ai_score > 0.5 AND kind NOT IN ('best', 'good', 'edited')))
SELECT session_id, chosen, t AS rejected, coalesce(nullif(concat_ws('; ', CASE WHEN kind IN ('bad', 'ai_like') THEN 'user_marked_' || kind END, CASE WHEN ai_score > 0.5 THEN printf('high_ai_score(%.2f)', ai_score) END), ''), 'unspecified') AS reason FROM g JOIN r USING (session_id) WHERE r = 1 AND chosen <> t""",
    "dpo_pairs_basic": f"WITH {_SESSIONS} SELECT session_id, max_by(text, pos) FILTER (kind = 'best') AS chosen, max_by(text, pos) FILTER (kind = 'bad') AS rejected FROM t GROUP BY session_id HAVING count(*) FILTER (kind = 'best') > 0 AND count(*) FILTER (kind = 'bad') > 0",
    "dpo_pairs_script": f"WITH {_SESSIONS} SELECT a.session_id, a.input_text AS prompt, a.t AS chosen, b.text AS rejected FROM t a JOIN t b USING (session_id) WHERE a.kind IN ('edited', 'best', 'good') AND b.kind = 'bad' AND a.input_text <> ''",
    "loss_summary": f"""WITH {_STEPS} SELECT run, count(*) AS steps, min_by(loss, step) AS first_loss, max_by(loss, step) AS last_loss, min(loss) AS least_loss, round(avg(loss), 4) AS mean_loss, round((min_by(loss, step) - max_by(loss, step)) / min_by(loss, step) * 100, 4) AS reduction_pct,
round(avg(speed) FILTER (speed > 0), 4) AS mean_speed, max(memory) FILTER (memory > 0) AS most_memory FROM s GROUP BY run""",
    "moving_avg_partial": f"WITH {_STEPS} SELECT run, step, round(CASE WHEN count(*) OVER (PARTITION BY run) < 20 THEN loss ELSE avg(loss) OVER (PARTITION BY run ORDER BY step ROWS 19 PRECEDING) END, 6) AS average FROM s",
    "moving_avg_valid": f"WITH {_STEPS}, a AS (SELECT run, step, avg(loss) OVER w AS a, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT run, step, round(a, 6) AS average FROM a WHERE n = 20",
    "running_best": f"WITH {_STEPS}, b AS (SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step) AS best, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT run, step, best, before IS NULL OR loss < before AS improved FROM b",
    "step_sample": f"""WITH {_STEPS}, n AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM s), k AS (SELECT DISTINCT run, n, CASE WHEN n <= 60 THEN j ELSE CAST(floor(j * n / 60) AS BIGINT) END AS i FROM n, range(60) r(j))
SELECT n.run, step, loss FROM n JOIN k ON k.run = n.run AND k.i = n.i""",
    "log_parse": """SELECT event_id AS step, CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS kind, CAST(printf('%.3f', value) AS DOUBLE) AS loss, CASE WHEN event_id % 5 IN (3, 4) THEN 1e-05 END AS rate,
CASE WHEN event_id % 5 IN (3, 4) THEN CAST(user_id AS DOUBLE) END AS speed, CASE WHEN event_id % 5 = 2 THEN 2.0 WHEN event_id % 5 IN (3, 4) THEN CAST(event_id % 9 AS DOUBLE) END AS memory_gb FROM events WHERE event_id % 5 <> 1""",
    "registry_latest": "WITH r AS (SELECT o_orderkey AS run, o_orderpriority AS base, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS a FROM orders) SELECT run, base, a = 1 AS recommended FROM r WHERE r = 1",
    "run_listing": "SELECT o_orderkey AS run, o_orderpriority AS base FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
    "memory_tier": "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'large' END AS name, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY 1",
    "plan_scores": f"""WITH g AS (SELECT seq, batch, accum, rank, {_memory} AS memory_gb, batch * accum AS effective FROM (VALUES (512), (1024), (2048)) a(seq), (VALUES (1), (2), (4)) b(batch), (VALUES (1), (2), (4), (8)) c(accum), (VALUES (8), (16)) e(rank)),
f AS (SELECT *, row_number() OVER (PARTITION BY effective, seq, rank ORDER BY batch) AS r FROM g WHERE memory_gb <= 16 * 0.85),
s AS (SELECT seq, batch, accum, rank, memory_gb, effective, round(0.3::DOUBLE * (batch / seq * 1024.0::DOUBLE) / max(batch / seq * 1024.0::DOUBLE) OVER () + 0.4::DOUBLE * greatest(0.0, least(1.0, (1.0 - memory_gb / 16.0) / 0.15::DOUBLE)) + 0.3::DOUBLE * sqrt(effective / max(effective) OVER ()), 6) AS score FROM f WHERE r = 1)
SELECT *, row_number() OVER (ORDER BY score DESC, effective DESC, seq DESC, rank) AS place FROM s""",
    "oom_fallback": """WITH RECURSIVE c AS (SELECT p_partkey AS id, 0 AS attempt, 1 + p_size % 3 AS eval_batch, 1 + p_size % 5 AS batch, 512 + 256 * (p_size % 7) AS seq, 4 + p_size % 29 AS layers FROM part
UNION ALL SELECT id, attempt + 1, CASE WHEN eval_batch > 1 THEN eval_batch // 2 ELSE eval_batch END, CASE WHEN eval_batch = 1 AND batch > 1 THEN batch // 2 ELSE batch END,
CASE WHEN eval_batch = 1 AND batch = 1 AND seq > 512 THEN greatest(512, seq // 2 // 256 * 256) ELSE seq END, CASE WHEN eval_batch = 1 AND batch = 1 AND seq <= 512 THEN greatest(4, layers // 2) ELSE layers END
FROM c WHERE attempt < 12 AND (eval_batch > 1 OR batch > 1 OR seq > 512 OR layers > 4)) SELECT * FROM c""",
}
