"""Reports on training runs and models, the planner's checks and the registry's documents.

Steps are rows of (run, step, loss, ...); every report is one aggregation by run or model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("avg_sentence_length", "discourse_marker_density", "subordination_density", "hedging_density", "precision_marker_density", "transition_phrases")


def throughput(steps: DataFrame) -> DataFrame:
    """By run: mean speed of all steps, mean of those above 0, and the greatest; 0 where there is none."""
    some = F.when(F.col("speed") > 0, F.col("speed"))
    return steps.groupBy("run").agg(*(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(n) for n, x in (("mean_all", F.avg("speed")), ("mean_positive", F.avg(some)), ("most", F.max("speed")))))


def evaluation(evals: DataFrame, events: DataFrame) -> DataFrame:
    """By run of `evals` (run, step, loss): best and final loss, and the run's out-of-memory events in `events` (run, kind)."""
    ooms = events.groupBy("run").agg(F.count_if(F.col("kind") == "oom_fallback").alias("ooms"))
    rows = evals.groupBy("run").agg(F.min("loss").alias("best"), F.max_by("loss", "step").alias("final"))
    return rows.join(ooms, "run", "left").select("run", "best", "final", F.coalesce("ooms", F.lit(0)).alias("ooms"))


def verdict(gap: Column) -> Column:
    """What the gap between the last evaluation and training loss tells."""
    return F.when(gap > 0.3, "overfitting likely").when(gap > 0.15, "mild overfitting").when(gap.isNotNull(), "good generalization")


def run_report(steps: DataFrame, evals: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a run: losses, gap to the evaluation, speed and gradient norms.

    `steps` has (run, step, loss, norm), `evals` (run, step, loss), `runs` (run, seconds, batch, gpus, accum). Norms of 0
    count for nothing; a norm above 5 is unstable. Gap and speed are null where a side is absent or no step was made.
    """
    norm = F.when(F.col("norm") != 0, F.col("norm"))
    rows = steps.groupBy("run").agg(
        F.max("step").alias("steps"), F.min_by("loss", "step").alias("initial"), F.max_by("loss", "step").alias("final"), F.min("loss").alias("best"),
        F.round(F.avg(norm), 4).alias("norm_mean"), F.max(norm).alias("norm_most"), F.min(norm).alias("norm_least"),
    )
    last = evals.groupBy("run").agg(F.min("loss").alias("best_eval"), F.max_by("loss", "step").alias("final_eval"))
    rows = rows.join(last, "run", "left").join(runs, "run", "left")
    pace, effective, gap = F.col("seconds") / F.nullif("steps", F.lit(0)), F.col("batch") * F.col("gpus") * F.col("accum"), F.col("final_eval") - F.col("final")
    return rows.select(
        "run", "steps", "initial", "final", "best", F.round((F.col("initial") - F.col("final")) / F.nullif("initial", F.lit(0.0)) * 100, 1).alias("reduction_pct"), "best_eval", "final_eval",
        F.round(gap, 4).alias("gap"), verdict(gap).alias("verdict"), F.round(pace, 1).alias("seconds_a_step"), effective.alias("effective"), F.round(effective / pace, 2).alias("samples_a_second"),
        "norm_mean", "norm_most", "norm_least", F.coalesce(F.col("norm_most") > 5.0, F.lit(False)).alias("unstable"),
    )


def comparison(scores: DataFrame) -> DataFrame:
    """By model: mean score, mean of each of the metrics (absent ones count as 0), and whether it wins, with its margin.

    The model of the greatest mean wins by its lead over the second; models that share it tie with a margin of 0.
    """
    rows = scores.groupBy("model").agg(F.avg("score").alias("_m"), *(F.round(F.avg(F.coalesce(m, F.lit(0.0))), 2).alias(m) for m in METRICS))
    all_ = Window.orderBy(F.desc("_m")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a model
    means = F.collect_list("_m").over(all_)
    top, second = F.element_at(means, 1), F.when(F.size(means) > 1, F.get(means, F.lit(1)))
    outcome = F.when(F.col("_m") < top, "loses").when(second == top, "tie").otherwise("wins")
    return rows.withColumn("outcome", outcome).withColumn("margin", F.when(outcome == "wins", F.round(top - second, 1)).otherwise(0.0)).withColumn("mean_score", F.round("_m", 1)).drop("_m")


def windows(counts: DataFrame) -> DataFrame:
    """(run, n, plotted, drawn): window sizes of the two smoothing rules; null where a run is too short to smooth."""
    n = F.col("n")
    return counts.select("run", "n", F.when(n > 5, F.greatest(F.lit(3), F.floor(n / 8))).cast("long").alias("plotted"), F.when(n > 20, F.least(F.lit(50), F.floor(n / 10))).cast("long").alias("drawn"))


def progress(steps: DataFrame, last: int = 20) -> DataFrame:
    """(run, step, rate, remaining): steps a second since the start, and seconds left by the mean of the `last` step times.

    `steps` has (run, step, elapsed, total); the rate of an elapsed time of 0 is 0.
    """
    order = Window.partitionBy("run").orderBy("step")
    taken = F.col("elapsed") - F.coalesce(F.lag("elapsed").over(order), F.lit(0.0))
    rows = steps.withColumn("_t", taken).withColumn("_a", F.avg("_t").over(order.rowsBetween(1 - last, 0)))
    return rows.select("run", "step", F.when(F.col("elapsed") > 0, F.round(F.col("step") / F.col("elapsed"), 6)).otherwise(0.0).alias("rate"), F.round((F.col("total") - F.col("step")) * F.col("_a"), 4).alias("remaining"))


def columns_of(steps: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row a run with an array for each of `names`, in the order of the steps: a run's steps, for a plot."""
    rows = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", *(n for n in names if n != "step")))).alias("_s"))
    return rows.select("run", *(F.col(f"_s.{n}").alias(n) for n in names))


def dry_run(outputs: DataFrame) -> DataFrame:
    """(id, speed, memory_gb, rate) of what trial runs of `steps` steps in `seconds` printed; null where it isn't there."""
    number = lambda p: F.nullif(F.regexp_extract("output", p, 1), F.lit("")).cast("double")
    return outputs.select("id", number(r"tok/s:\s*([0-9.]+)").alias("speed"), number(r"Peak memory:\s*([0-9.]+)\s*GB").alias("memory_gb"), F.round(F.col("steps") / F.nullif("seconds", F.lit(0.0)), 6).alias("rate"))


def safe_layers(memory: Column, most: Column) -> Column:
    """Layers that fit: four below the first of 4, 8, 12, 16, 24, 32 whose share of `memory` is above 70 % of `most`, 4 at least; else 32."""
    out = F.lit(32)
    for layers in (32, 24, 16, 12, 8, 4):
        out = F.when(memory * (layers / 32) > most * 0.7, max(4, layers - 4)).otherwise(out)
    return out


def scored_plans(candidates: DataFrame, available: float = 16.0, margin: float = 0.85) -> DataFrame:
    """`candidates` (id, speed, memory_gb, effective, success) with `score`, best first by `place`.

    Failed ones are left out; if none succeeded all stay, without a score. Ties go to the lesser id.
    """
    all_ = Window.partitionBy()
    rows = candidates.withColumn("_any", F.max(F.col("success").cast("int")).over(all_)).where("success OR _any = 0")
    fast, wide = F.max("speed").over(all_), F.max("effective").over(all_)
    stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("memory_gb") / available / margin))
    score = F.when(F.col("success"), F.round(F.when(fast > 0, F.col("speed") / fast).otherwise(0.0) * 0.3 + stable * 0.4 + F.sqrt(F.col("effective") / wide) * 0.3, 6))
    return rows.withColumn("score", score).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id"))).drop("_any")


def chosen_plan(scored: DataFrame, default: DataFrame) -> DataFrame:
    """The first plan with a score; without one the row of `default`, of the same columns."""
    first = scored.where("score IS NOT NULL").orderBy("place").limit(1)
    return first.withColumn("_o", F.lit(0)).unionByName(default.withColumn("_o", F.lit(1))).orderBy("_o").limit(1).drop("_o")


def profile(rows: DataFrame, profiles: DataFrame, column: str = "memory_gb", prefix: str = "mac_") -> DataFrame:
    """`rows` with `profile`: the first by `place` whose name starts with `prefix` and whose half-open range holds `column`, else 'conservative'.

    `profiles` has (place, name, low, high), a null bound being open; it is a table of settings, of a few rows. Rows
    are numbered apart, so repeated ones stay. No row is dropped for having no range.
    """
    near = profiles.where(F.col("name").startswith(prefix)).agg(F.array_sort(F.collect_list(F.struct("place", "name", "low", "high"))).alias("_p"))
    fits = lambda p: (F.coalesce(p["low"], F.lit(0.0)) <= F.col(column)) & (p["high"].isNull() | (F.col(column) < p["high"]))
    return rows.crossJoin(F.broadcast(near)).withColumn("profile", F.coalesce(F.get(F.filter("_p", fits), F.lit(0))["name"], F.lit("conservative"))).drop("_p")


def registry(models: DataFrame) -> DataFrame:
    """By base: models, the next version's number, and the last by name."""
    return models.groupBy("base").agg(F.count(F.lit(1)).alias("models"), (F.count(F.lit(1)) + 1).alias("next_version"), F.max("name").alias("last"))


def named_day(name: Column) -> Column:
    """'Mon D' of the first part of a run's name that is a date of eight digits; year-month-day if the month isn't one, '' without a date."""
    part = F.regexp_extract(name, r"(?:^|-)([0-9]{8})(?:-|$)", 1)
    month, day = F.substring(part, 5, 2).cast("int"), F.substring(part, 7, 2).cast("int")
    months = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    spelt = F.concat(F.get(months, month - 1), F.lit(" "), day)
    return F.when(part == "", "").when(month.between(1, 12), spelt).otherwise(F.concat_ws("-", F.substring(part, 1, 4), F.substring(part, 5, 2), F.substring(part, 7, 2)))
