"""Preference feedback: statistics and chosen-rejected pairs.

A session is a row of (session_id, input_text, variants), variants being structs of
(pos, feedback_type, text, edited, ai_score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("best", "good", "bad", "edited", "ai_like")


def flat(sessions: DataFrame) -> DataFrame:
    """One row for each variant."""
    return sessions.select("session_id", "input_text", F.explode("variants").alias("v")).select("session_id", "input_text", "v.*")


def stats(sessions: DataFrame) -> DataFrame:
    """One row: sessions, variants and the count of each kind; unknown kinds count in the total alone."""
    kind = F.col("feedback_type")
    return flat(sessions).agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("variants"), *(F.count_if(kind == k).alias(k) for k in KINDS))


def reason(kind: Column, score: Column, issues: Column | None = None) -> Column:
    """Why a variant is rejected: the user's mark, a high score, and the first two of its `issues` (names), if any."""
    found = [F.when(kind.isin("bad", "ai_like"), F.concat(F.lit("user_marked_"), kind)), F.when(score > 0.5, F.format_string("high_ai_score(%.2f)", score))]
    if issues is not None:
        found.append(F.when(F.size(issues) > 0, F.concat(F.lit("issues:"), F.array_join(F.slice(issues, 1, 2), ","))))
    return F.coalesce(F.nullif(F.concat_ws("; ", *found), F.lit("")), F.lit("unspecified"))


def _first(rows: DataFrame) -> DataFrame:
    """One row for each text of a session, the first by place."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("session_id", "t").orderBy("rank", "pos"))).where("_r = 1").drop("_r")


def pairs(sessions: DataFrame) -> DataFrame:
    """(session_id, chosen, rejected, reason): every preferred with every rejected text of a session that differs from it.

    Preferred are edited and best ones, and good ones below 0.4; rejected are bad and
    ai-like ones, and any other above 0.5.
    """
    v = flat(sessions).withColumn("t", F.coalesce(F.nullif(F.col("edited"), F.lit("")), F.col("text"))).where("t <> ''")
    kind, score = F.col("feedback_type"), F.col("ai_score")
    good = (kind == "edited") | (kind == "best") | ((kind == "good") & (score < 0.4))
    bad = kind.isin("bad", "ai_like") | ((score > 0.5) & ~kind.isin("best", "good", "edited"))
    preferred = _first(v.where(good).withColumn("rank", F.when(kind == "edited", 0).when(kind == "best", 1).otherwise(2)))
    rejected = _first(v.where(bad).withColumn("rank", F.when(kind == "bad", 0).when(kind == "ai_like", 1).otherwise(2)))
    one = preferred.select("session_id", F.col("t").alias("chosen"))
    two = rejected.select("session_id", F.col("t").alias("rejected"), reason(kind, score).alias("reason"))
    return one.join(two, "session_id").where("chosen <> rejected")


def last_pair(sessions: DataFrame) -> DataFrame:
    """(session_id, chosen, rejected): a session's last best and last bad text, where it has both."""
    v = flat(sessions)
    rows = v.groupBy("session_id").agg(*(F.max_by(F.when(F.col("feedback_type") == k, F.col("text")), F.when(F.col("feedback_type") == k, F.col("pos"))).alias(n) for k, n in (("best", "chosen"), ("bad", "rejected"))))
    return rows.where("chosen IS NOT NULL AND rejected IS NOT NULL")


def scripted_pairs(sessions: DataFrame) -> DataFrame:
    """(session_id, prompt, chosen, rejected): edited, best and good against bad, of sessions with an input; repeats stay.

    If `sessions` has a `section`, prompts begin with it where it is set.
    """
    if "section" in sessions.columns:
        named = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.format_string("[Section: %s]\n\n", "section")).otherwise("")
        sessions = sessions.withColumn("input_text", F.when(F.col("input_text") != "", F.concat(named, "input_text")).otherwise(F.col("input_text")))
    v = flat(sessions).where("input_text <> ''")
    one = v.where(F.col("feedback_type").isin("edited", "best", "good")).select("session_id", F.col("input_text").alias("prompt"), F.when(F.col("feedback_type") == "edited", F.col("edited")).otherwise(F.col("text")).alias("chosen"))
    return one.join(v.where("feedback_type = 'bad'").select("session_id", F.col("text").alias("rejected")), "session_id")
