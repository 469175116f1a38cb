"""Queries of reports, checks and work lists, derived from the tables of a folder; their SQL has its own literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import curation, reports, trainset
from folio.plans.corpus import ESTIMATE, PARTS, SPACE
from folio.sources.tables import table


def _steps(spark, d):
    """Events as steps: a run for each type; every fifth is an evaluation."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("user_id") % 50).cast("double").alias("speed"), (F.col("event_id") % 7).cast("double").alias("norm"),
        F.when(F.col("event_id") % 11 == 0, "oom_fallback").otherwise("step").alias("kind"), (F.col("event_id") * 2 + F.col("event_id") % 3).cast("double").alias("elapsed"), F.lit(1000000).cast("long").alias("total"),
    )


def throughput_summary(spark, d):
    """Mean speeds of every run, with and without zeros."""
    return reports.throughput(_steps(spark, d))


def eval_summary(spark, d):
    """Best and final evaluation loss, and out-of-memory events, of every run."""
    s = _steps(spark, d)
    return reports.evaluation(s.where("step % 5 = 0"), s)


def run_report(spark, d):
    """The report of every run."""
    s = _steps(spark, d)
    runs = s.groupBy("run").agg((F.max("step") * 1.5).alias("seconds")).select("run", "seconds", F.lit(4).alias("batch"), F.lit(2).alias("gpus"), F.lit(8).alias("accum"))
    return reports.run_report(s.where("step % 5 <> 0"), s.where("step % 5 = 0"), runs)


def model_comparison(spark, d):
    """Priorities of orders as models, compared by price."""
    o = table(spark, d, "orders")
    metrics = [F.when(F.col("o_orderkey") % (k + 2) != 0, (F.col("o_custkey") % (10 + k)).cast("double")).alias(m) for k, m in enumerate(reports.METRICS)]
    return reports.comparison(o.select(F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 1000).alias("score"), *metrics))


def window_sizes(spark, d):
    """Smoothing windows of every customer's number of orders, as runs."""
    return reports.windows(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("n")))


def step_progress(spark, d):
    """Rate and remaining time at every step."""
    return reports.progress(_steps(spark, d))


def column_export(spark, d):
    """Losses and speeds of every run in the order of its steps."""
    rows = reports.columns_of(_steps(spark, d), ("step", "loss", "speed"))
    return rows.select("run", F.size("step").alias("n"), F.md5(F.concat_ws(",", F.transform("step", lambda x: x.cast("string")))).alias("steps"), F.round(F.element_at("loss", -1), 4).alias("last_loss"), F.element_at("speed", 1).alias("first_speed"))


def dry_run_parse(spark, d):
    """What trial runs printed, made from the parts."""
    p = table(spark, d, "part")
    speed = F.when(F.col("p_partkey") % 4 == 0, "no figures").otherwise(F.format_string("step done tok/s:  %d.5", F.col("p_size")))
    peak = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.format_string("\nPeak memory: %d.25 GB", F.col("p_size") % 20))
    return reports.dry_run(p.select(F.col("p_partkey").alias("id"), F.concat(speed, peak).alias("output"), F.lit(10).alias("steps"), (F.col("p_partkey") % 5).cast("double").alias("seconds")))


def safe_layers(spark, d):
    """Layers that fit for every part as a configuration of memory."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), reports.safe_layers(F.col("p_size").cast("double"), F.lit(16.0)).alias("layers"))


def _candidates(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10.0).alias("speed"), (F.col("p_size") % 15 + 1.0).alias("memory_gb"), (F.col("p_partkey") % 16 + 1).alias("effective"), (F.col("p_partkey") % 3 != 0).alias("success"))


def plan_ranking(spark, d):
    """Parts as plans, failed ones left out, scored and ranked."""
    return reports.scored_plans(_candidates(spark, d)).select("id", "score", "place")


def plan_ranking_failed(spark, d):
    """The same where none succeeded: all stay, without a score."""
    return reports.scored_plans(_candidates(spark, d).withColumn("success", F.lit(False))).select("id", "score", "place")


def plan_selection(spark, d):
    """The best plan, and the default where none succeeded."""
    default = spark.createDataFrame([(-1, 0.0, 4.0, 4, True, 0.0, 0)], "id long, speed double, memory_gb double, effective long, success boolean, score double, place int")
    one = reports.chosen_plan(reports.scored_plans(_candidates(spark, d)), default).select(F.lit("some").alias("case"), "id")
    two = reports.chosen_plan(reports.scored_plans(_candidates(spark, d).withColumn("success", F.lit(False))), default).select(F.lit("none").alias("case"), "id")
    return one.unionByName(two)


def profile_lookup(spark, d):
    """The first profile whose range holds each part's size as memory."""
    profiles = spark.createDataFrame([(1, "cuda_any", None, None), (2, "mac_8", 8.0, 16.0), (3, "mac_16", 16.0, 32.0), (4, "mac_wide", 24.0, None)], "place int, name string, low double, high double")
    return reports.profile(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("memory_gb")), profiles).select("id", "profile")


def registry_document(spark, d):
    """Models by base, the next version and the last by name."""
    return reports.registry(table(spark, d, "part").select(F.col("p_type").alias("base"), F.col("p_name").alias("name")))


def run_dates(spark, d):
    """Days in the names of runs made from the orders."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("run-lora-"), F.when(F.col("o_orderkey") % 9 == 0, "20249905").when(F.col("o_orderkey") % 7 == 0, "latest").otherwise(F.date_format("o_orderdate", "yyyyMMdd")), F.lit("-101500"))
    return o.select(F.col("o_orderkey").alias("id"), reports.named_day(name).alias("day"))


def corpus_totals(spark, d):
    """Documents, words, sentences and distinct sources of the corpus; rows by label."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    t = F.col("text")
    return docs.agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.size(text.parts(t))).alias("words"), F.sum(F.size(F.filter(curation.sentences_by_stop(t), lambda x: x != ""))).alias("sentences"), F.countDistinct("source").alias("sources"),
        F.count_if(F.col("quality") == 1).alias("priority"), F.count_if(F.coalesce(F.col("quality"), F.lit(0)) != 1).alias("regular"),
    )


def distinct_sources(spark, d):
    """The sources of the documents, in order."""
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


def weight_stats(spark, d):
    """Copies, weight and priority of every document of the weighted corpus."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 == 0).alias("is_priority"))
    weights = docs.where("doc_id % 7 = 0").select("doc_id", (F.lit(0.5) + F.col("doc_id") % 4).alias("weight"))
    rows = trainset.weighted(docs, weights, docs.where("doc_id % 13 = 0").select("doc_id"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.max(F.col("doc_id") % 10 == 0).alias("is_priority"))


def answer_check(spark, d):
    """Answers made from the documents, without introductions, too short ones null, too long ones cut."""
    t, k = F.col("text"), F.col("doc_id") % 6
    given = F.when(k == 0, F.substring(t, 1, 5)).when(k == 1, F.concat(F.lit("Here is the text:\n  "), t)).when(k == 2, F.concat(t, t, t, t)).when(k == 3, F.concat(F.lit("Sure, "), t)).when(k == 4, F.concat(F.lit("Sure,\nOutput: as asked\n"), t)).otherwise(t)
    out = curation.answer(given, t)
    return table(spark, d, "documents").select("doc_id", F.length(out).alias("length"), F.md5(out).alias("answer"))


def request_check(spark, d):
    """Broken fields of requests made from the turns."""
    c = table(spark, d, "conversations")
    role = F.when(F.col("conv_id") % 9 == 0, "robot").otherwise(F.col("role"))
    rows = c.select("conv_id", "turn", F.when(F.col("conv_id") % 8 == 0, F.repeat(F.lit(" "), F.lit(20))).otherwise(F.substring("text", 1, 12)).alias("text"), (F.col("turn") % 7).alias("n_variants"), (F.col("conv_id") * 100).alias("max_tokens"), F.col("turn").alias("variant_index"), role.alias("role"))
    return rows.select("conv_id", "turn", F.concat_ws(",", curation.request_errors(rows)).alias("errors"))


def corpus_health(spark, d):
    """Warnings on each source as a corpus of its own would have them, by language as files."""
    docs = table(spark, d, "documents")
    files = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("bytes")).withColumn("is_priority", F.lit(False))
    return curation.health(files)


def prompt_templates(spark, d):
    """Length and hash of the four texts of an instruction row."""
    docs = table(spark, d, "documents")
    given = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 40)).otherwise("")
    made = curation.templates(F.lit("Continue."), given, F.substring("text", 41, 200))
    return docs.select("doc_id", *(F.md5(c).alias(n) for n, c in made.items()))


def evaluation_record(spark, d):
    """Cut texts and prompt lengths of evaluation rows made from the documents."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("Rewrite it.").alias("instruction"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("input"), F.reverse("text").alias("output"))
    return curation.evaluation_record(docs).select("doc_id", F.length("instruction").alias("instruction"), F.md5("input").alias("input"), F.md5("reference").alias("reference"), "prompt_length")


def first_halves(spark, d):
    """First half of every text, and its pieces by full stops."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(curation.first_half(t)).alias("half"), F.size(curation.sentences_by_stop(t)).alias("pieces"))


def config_hashes(spark, d):
    """Hashes of configurations made from the parts."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), curation.config_hash(seed=F.lit("42"), batch_size=F.col("p_size").cast("string"), model_id=F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).alias("hash"))


def json_scores(spark, d):
    """Clamped scores in answers made from the parts."""
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit('{"overall_score": '), (F.col("p_size") * 5).cast("string"), F.lit(', "dimensions": [{"name": "clarity", "score": '), size, F.lit(', "feedback": "ok"}], "suggestions": ["a","b","c","d","e","f"]}'))
    answer = F.when(F.col("p_partkey") % 5 == 0, "no figures here").when(F.col("p_partkey") % 5 == 1, '{"summary": "x"}').otherwise(F.concat(F.lit("Well:\n```\n"), body, F.lit("\n```")))
    rows = curation.judged(p.select(F.col("p_partkey").alias("id"), answer.alias("answer")))
    return rows.select("id", "overall", F.size("dimensions").alias("dimensions"), F.get("dimensions", F.lit(0))["score"].alias("first_score"), F.size("suggestions").alias("suggestions"))


def weights_by_name(spark, d):
    """Parts with the weight of the last word that their name holds."""
    weights = spark.createDataFrame([(1, "ring", 2.0), (2, "small", 3.0), (3, "a", 0.5), (4, "b", 1.5)], "place int, part string, value double")
    return curation.weights_by_part(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(1.0).alias("weight")), weights).select("id", "weight")


def session_join(spark, d):
    """Feedback with the variants of its session, by place; turns of conversations are the variants."""
    c = table(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("text"), F.col("role").alias("strategy"))))
    sessions = c.where("conv_id % 5 <> 0").groupBy(F.col("conv_id").alias("session_id")).agg(turns.alias("variants")).withColumn("model_version", F.lit("m1"))
    feedback = c.select(F.col("conv_id").alias("session_id"), (F.col("turn") + F.col("conv_id") % 2).cast("int").alias("variant_index"), F.lit("good").alias("feedback_type"))
    return curation.with_session(feedback, sessions)


def variant_work_list(spark, d):
    """Variants of the documents' first pairs that don't exist yet."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("para_id"))
    pairs = docs.where("para_id % 2 = 0").withColumn("variant", F.when(F.col("para_id") % 4 == 0, "v1")).unionByName(docs.where("para_id % 6 = 0").withColumn("variant", F.lit("v2")))
    return curation.work_list(pairs)


def variant_settings(spark, d):
    """Strategies and temperatures of the variants of requests made from the parts."""
    n = (1 + F.col("p_size") % 5).cast("int")
    asked = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("B"), F.lit("D")))
    heat = curation.temperatures(F.lit(0.7), F.lit(0.15), n)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(curation.strategies(asked, n), "").alias("strategies"), F.size(heat).alias("n"), F.array_min(heat).alias("least"), F.array_max(heat).alias("most"))


def second_split(spark, d):
    """The documents' training part split again, and whether so many are over the limit that chunking runs."""
    docs = table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("e"))
    first = trainset.split(docs, "doc_id").where("split = 'train'").drop("split")
    again = trainset.split(first, "doc_id", seed=43).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    over = docs.agg((F.count_if(F.col("e") > 1024) / F.count(F.lit(1)) * 100).alias("pct")).select((F.col("pct") > 1).alias("by_command"), (F.col("pct") > 5).alias("by_trainer"))
    return again.crossJoin(F.broadcast(over))


QUERIES = {
    f.__name__: f
    for f in (
        throughput_summary, eval_summary, run_report, model_comparison, window_sizes, step_progress, column_export, dry_run_parse, safe_layers, plan_ranking, plan_ranking_failed, plan_selection, profile_lookup,
        registry_document, run_dates, corpus_totals, distinct_sources, weight_stats, answer_check, request_check, corpus_health, prompt_templates, evaluation_record, first_halves, config_hashes, json_scores,
        weights_by_name, session_join, variant_work_list, variant_settings, second_split,
    )
}

_STRIP = f"regexp_replace(regexp_replace(%s, '^{SPACE}+', ''), '{SPACE}+$', '')"
_S = """s AS (SELECT event_type AS run, event_id AS step, value AS loss, CAST(user_id % 50 AS DOUBLE) AS speed, CAST(event_id % 7 AS DOUBLE) AS norm,
CASE WHEN event_id % 11 = 0 THEN 'oom_fallback' ELSE 'step' END AS kind, CAST(event_id * 2 + event_id % 3 AS DOUBLE) AS elapsed FROM events)"""
_METRIC = ("avg_sentence_length", "discourse_marker_density", "subordination_density", "hedging_density", "precision_marker_density", "transition_phrases")
_means = ", ".join(f"round(avg(CASE WHEN o_orderkey % {k + 2} <> 0 THEN CAST(o_custkey % {10 + k} AS DOUBLE) ELSE 0 END), 2) AS {m}" for k, m in enumerate(_METRIC))
_P = "p AS (SELECT p_partkey AS id, p_size * 10.0 AS speed, p_size % 15 + 1.0 AS memory_gb, p_partkey % 16 + 1 AS effective, p_partkey % 3 <> 0 AS success FROM part)"
_RANKED = f"""{_P}, k AS (SELECT id, round(0.3::DOUBLE * (speed / max(speed) OVER ()) + 0.4::DOUBLE * greatest(0.0, least(1.0, 1.0 - memory_gb::DOUBLE / 16.0 / 0.85::DOUBLE)) + 0.3::DOUBLE * sqrt(effective / max(effective) OVER ()), 6) AS score FROM p WHERE success),
r AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM k)"""
_cut = _STRIP % "substr(s, position(chr(10) IN s) + 1)"
_cleaned = "['Here is', 'Here''s', 'Rewritten:', 'Output:', 'Sure,', 'Restructured:', 'Condensed:']"
_half = "substr(text, 1, length(text) // 2)"

ORACLES = {
    "throughput_summary": f"WITH {_S} SELECT run, round(avg(speed), 6) AS mean_all, round(coalesce(avg(speed) FILTER (speed > 0), 0.0), 6) AS mean_positive, round(max(speed), 6) AS most FROM s GROUP BY run",
    "eval_summary": f"WITH {_S} SELECT run, min(loss) FILTER (step % 5 = 0) AS best, max_by(loss, step) FILTER (step % 5 = 0) AS final, count(*) FILTER (kind = 'oom_fallback') AS ooms FROM s GROUP BY run HAVING count(*) FILTER (step % 5 = 0) > 0",
    "run_report": f"""WITH {_S}, r AS (SELECT run, max(step) * 1.5 AS seconds FROM s GROUP BY run),
t AS (SELECT run, max(step) AS steps, min_by(loss, step) AS initial, max_by(loss, step) AS final, min(loss) AS best, round(avg(norm) FILTER (norm <> 0), 4) AS norm_mean, max(norm) FILTER (norm <> 0) AS norm_most, min(norm) FILTER (norm <> 0) AS norm_least FROM s WHERE step % 5 <> 0 GROUP BY run),
e AS (SELECT run, min(loss) AS best_eval, max_by(loss, step) AS final_eval FROM s WHERE step % 5 = 0 GROUP BY run)
SELECT run, steps, initial, final, best, round((initial - final) / nullif(initial, 0) * 100, 1) AS reduction_pct, best_eval, final_eval, round(final_eval - final, 4) AS gap,
CASE WHEN final_eval - final > 0.3 THEN 'overfitting likely' WHEN final_eval - final > 0.15 THEN 'mild overfitting' WHEN final_eval IS NOT NULL THEN 'good generalization' END AS verdict,
round(CAST(seconds AS DOUBLE) / nullif(steps, 0), 1) AS seconds_a_step, 64 AS effective, round(64 / (CAST(seconds AS DOUBLE) / nullif(steps, 0)), 2) AS samples_a_second, norm_mean, norm_most, norm_least, coalesce(norm_most > 5, false) AS unstable
FROM t LEFT JOIN e USING (run) LEFT JOIN r USING (run)""",
    "model_comparison": f"""WITH m AS (SELECT o_orderpriority AS model, avg(o_totalprice / 1000) AS m, {_means} FROM orders GROUP BY 1), k AS (SELECT *, max(m) OVER () AS top, nth_value(m, 2) OVER (ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM m)
SELECT model, {", ".join(_METRIC)}, CASE WHEN m < top THEN 'loses' WHEN second = top THEN 'tie' ELSE 'wins' END AS outcome, CASE WHEN m = top AND second <> top THEN round(top - second, 1) ELSE 0.0 END AS margin, round(m, 1) AS mean_score FROM k""",
    "window_sizes": "SELECT run, n, CASE WHEN n > 5 THEN greatest(3, n // 8) END AS plotted, CASE WHEN n > 20 THEN least(50, n // 10) END AS drawn FROM (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY 1)",
    "step_progress": f"""WITH {_S}, t AS (SELECT *, elapsed - coalesce(lag(elapsed) OVER (PARTITION BY run ORDER BY step), 0) AS taken FROM s)
SELECT run, step, CASE WHEN elapsed > 0 THEN round(step / elapsed, 6) ELSE 0.0 END AS rate, round((1000000 - step) * avg(taken) OVER (PARTITION BY run ORDER BY step ROWS 19 PRECEDING), 4) AS remaining FROM t""",
    "column_export": f"WITH {_S} SELECT run, CAST(count(*) AS INTEGER) AS n, md5(string_agg(step, ',' ORDER BY step)) AS steps, round(max_by(loss, step), 4) AS last_loss, min_by(speed, step) AS first_speed FROM s GROUP BY run",
    "dry_run_parse": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 0.5::DOUBLE END AS speed, CASE WHEN p_partkey % 3 <> 0 THEN p_size % 20 + 0.25::DOUBLE END AS memory_gb, round(10 / CAST(nullif(p_partkey % 5, 0) AS DOUBLE), 6) AS rate FROM part",
    "safe_layers": "SELECT p_partkey AS id, CASE WHEN p_size * 0.125::DOUBLE > 11.2 THEN 4 WHEN p_size * 0.25::DOUBLE > 11.2 THEN 4 WHEN p_size * 0.375::DOUBLE > 11.2 THEN 8 WHEN p_size * 0.5::DOUBLE > 11.2 THEN 12 WHEN p_size * 0.75::DOUBLE > 11.2 THEN 20 WHEN p_size > 11.2 THEN 28 ELSE 32 END AS layers FROM part",
    "plan_ranking": f"WITH {_RANKED} SELECT * FROM r",
    "plan_ranking_failed": "SELECT p_partkey AS id, CAST(NULL AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS place FROM part",
    "plan_selection": f"WITH {_RANKED} SELECT 'some' AS \"case\", id FROM r WHERE place = 1 UNION ALL SELECT 'none', -1",
    "profile_lookup": "SELECT p_partkey AS id, CASE WHEN p_size >= 8 AND p_size < 16 THEN 'mac_8' WHEN p_size >= 16 AND p_size < 32 THEN 'mac_16' WHEN p_size >= 32 THEN 'mac_wide' ELSE 'conservative' END AS profile FROM part",
    "registry_document": "SELECT p_type AS base, count(*) AS models, count(*) + 1 AS next_version, max(p_name) AS last FROM part GROUP BY 1",
    "run_dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '2024-99-05' WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) END AS day FROM orders",
    "corpus_totals": f"""WITH d AS (SELECT text, source, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS paragraphs, CAST(sum(len({PARTS})) AS BIGINT) AS words, CAST(sum(len(list_filter(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), lambda x: x <> ''))) AS BIGINT) AS sentences, count(DISTINCT source) AS sources,
count(*) FILTER (quality = 1) AS priority, count(*) FILTER (coalesce(quality, 0) <> 1) AS regular FROM d""",
    "distinct_sources": "SELECT DISTINCT source FROM documents ORDER BY source",
    "weight_stats": """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2.5 WHEN doc_id % 7 = 0 THEN 0.5 + doc_id % 4 ELSE 1.0 END::DOUBLE AS weight FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CAST(sum(greatest(1, trunc(weight))) AS BIGINT) AS copies, max(weight) AS weight, bool_or(doc_id % 10 = 0) AS is_priority FROM w GROUP BY doc_id""",
    "answer_check": f"""WITH g AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 5) WHEN 1 THEN 'Here is the text:' || chr(10) || '  ' || text WHEN 2 THEN text || text || text || text WHEN 3 THEN 'Sure, ' || text WHEN 4 THEN 'Sure,' || chr(10) || 'Output: as asked' || chr(10) || text ELSE text END AS given FROM documents),
a AS (SELECT doc_id, text, given, CASE WHEN length(given) > length(text) * 3 THEN substr(given, 1, length(text) * 2) ELSE given END AS a FROM g), c AS (SELECT doc_id, CASE WHEN length(given) >= length(text) * 0.3::DOUBLE THEN list_reduce({_cleaned}, lambda s, x: CASE WHEN starts_with(s, x) AND contains(s, chr(10)) THEN {_cut} ELSE s END, a) END AS a FROM a)
SELECT doc_id, length(a) AS length, md5(a) AS answer FROM c""",
    "request_check": """SELECT conv_id, turn, concat_ws(',', CASE WHEN conv_id % 8 = 0 OR length(text) < 10 OR trim(substr(text, 1, 12)) = '' THEN 'text' END, CASE WHEN turn % 7 NOT BETWEEN 1 AND 5 THEN 'n_variants' END, CASE WHEN conv_id * 100 NOT BETWEEN 1 AND 4096 THEN 'max_tokens' END,
CASE WHEN turn NOT BETWEEN 0 AND 4 THEN 'variant_index' END, CASE WHEN conv_id % 9 = 0 OR role NOT IN ('system', 'user', 'assistant') THEN 'role' END) AS errors FROM conversations""",
    "corpus_health": """SELECT count(*) AS files, CAST(0 AS BIGINT) AS priority, round(sum(b) / 1048576.0, 4) AS mb, concat_ws('; ', CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 5 THEN 'too few' WHEN count(*) < 10 THEN 'few' END, CASE WHEN count(*) > 0 THEN 'no priority' END, CASE WHEN sum(b) / 1048576.0 > 500 THEN 'large' END) AS warnings
FROM (SELECT lang, sum(length(text)) AS b FROM documents GROUP BY lang)""",
    "prompt_templates": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 40) ELSE '' END AS i, substr(text, 41, 200) AS o, chr(10) AS n FROM documents)
SELECT doc_id, md5('### Instruction:' || n || 'Continue.' || n || n || '### Input:' || n || i || n || n || '### Response:' || n || o) AS library,
md5('### Instruction:' || n || 'Continue.' || n || n || CASE WHEN i <> '' THEN '### Input:' || n || i || n || n ELSE '' END || '### Response:' || n || o) AS distributed,
md5('### Instruction: Continue.' || n || CASE WHEN i <> '' THEN '### Input: ' || i || n ELSE '' END || '### Response: ' || o) AS one_line,
md5('### Instruction:' || n || 'Continue.' || n || CASE WHEN i <> '' THEN '### Input:' || n || i || n ELSE '' END || '### Response:' || n || o) AS command FROM t""",
    "evaluation_record": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS i, reverse(text) AS o, chr(10) AS n FROM documents), p AS (SELECT *, '### Instruction:' || n || 'Rewrite it.' || CASE WHEN i <> '' THEN n || n || i ELSE '' END || n || n || '### Response:' || n AS whole,
'### Instruction:' || n || 'Rewrite it.' || CASE WHEN i <> '' THEN n || n || substr(i, 1, 500) || '...' ELSE '' END || n || n || '### Response:' || n AS cut FROM t)
SELECT doc_id, 11 AS instruction, md5(substr(i, 1, 200)) AS input, md5(substr(o, 1, 500)) AS reference, CAST(CASE WHEN length(whole) > 2000 THEN length(cut) ELSE length(whole) END AS INTEGER) AS prompt_length FROM p""",
    "first_halves": f"SELECT doc_id, md5({_half}) AS half, CAST(len(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS INTEGER) AS pieces FROM documents",
    "config_hashes": """SELECT p_partkey AS id, substr(md5('{"batch_size": ' || p_size || ', "model_id": "' || p_name || '", "seed": 42}'), 1, 8) AS hash FROM part""",
    "json_scores": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN 50 ELSE least(100, p_size * 5) END AS overall, CASE WHEN p_partkey % 5 = 1 THEN 0 ELSE 1 END AS dimensions, CASE WHEN p_partkey % 5 <> 1 THEN least(10, p_size) END AS first_score, CASE WHEN p_partkey % 5 = 1 THEN 0 ELSE 5 END AS suggestions FROM part WHERE p_partkey % 5 <> 0",
    "weights_by_name": "SELECT p_partkey AS id, CASE WHEN contains(p_name, 'b') THEN 1.5 WHEN contains(p_name, 'a') THEN 0.5 WHEN contains(p_name, 'small') THEN 3.0 WHEN contains(p_name, 'ring') THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM part",
    "session_join": """WITH v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, md5(text) AS text, role FROM conversations WHERE conv_id % 5 <> 0), f AS (SELECT conv_id, CAST(turn + conv_id % 2 AS INTEGER) AS i FROM conversations)
SELECT f.conv_id AS session_id, f.i AS variant_index, 'good' AS feedback_type, v.text AS original_text, v.role AS strategy, CASE WHEN f.conv_id % 5 <> 0 THEN 'm1' ELSE 'unknown' END AS model_version FROM f LEFT JOIN v ON v.conv_id = f.conv_id AND v.i = f.i""",
    "variant_work_list": "SELECT doc_id AS para_id, v AS variant FROM documents, (VALUES ('v2'), ('v3')) t(v) WHERE doc_id % 2 = 0 AND NOT (v = 'v2' AND doc_id % 6 = 0)",
    "variant_settings": """WITH n AS (SELECT p_partkey AS id, 1 + p_size % 5 AS n, p_partkey % 3 = 0 AS asked FROM part), h AS (SELECT *, list_transform(range(n), lambda i: round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + (i - n // 2) * 0.15::DOUBLE)), 6)) AS h FROM n)
SELECT id, CASE WHEN asked THEN substr('BDBDB', 1, n) ELSE substr('ABCD', 1, n) END AS strategies, CAST(n AS INTEGER) AS n, list_min(h) AS least, list_max(h) AS most FROM h""",
    "second_split": f"""WITH n AS (SELECT count(*) AS a, CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) AS n, count(*) FILTER ({ESTIMATE} > 1024) / count(*) * 100 AS pct FROM documents)
SELECT 'train' AS split, CAST(floor(n * 0.9::DOUBLE) AS BIGINT) AS n, pct > 1 AS by_command, pct > 5 AS by_trainer FROM n UNION ALL SELECT 'val', n - CAST(floor(n * 0.9::DOUBLE) AS BIGINT), pct > 1, pct > 5 FROM n""",
}
