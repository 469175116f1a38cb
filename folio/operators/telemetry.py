"""Training telemetry: log lines, summaries, moving averages, plans, fallbacks.

Steps are rows of (run, step, loss, speed, memory).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """(step, kind, loss, rate, speed, memory_gb) of log lines of training or validation; other lines are dropped."""
    line = F.col("line")
    number = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).cast("double")
    memory = number(r"(?i)peak mem(?:ory)?:? ([0-9.]+) ?[mg]b")
    rows = lines.select(
        number(r"Iter:? ([0-9]+)").cast("long").alias("step"), F.when(line.contains("Val loss"), "eval").otherwise("train").alias("kind"), number(r"(?:Train|Val) loss ([0-9.]+)").alias("loss"),
        number(r"Learning Rate ([0-9.eE+-]+)").alias("rate"), number(r"Tokens/sec ([0-9.]+)").alias("speed"), F.when(line.contains("MB"), memory / 1024).otherwise(memory).alias("memory_gb"),
    )
    return rows.where("step IS NOT NULL AND loss IS NOT NULL")


def summary(steps: DataFrame) -> DataFrame:
    """By run: steps, first, last, least and mean loss, reduction in percent, mean speed and most memory above 0."""
    return steps.groupBy("run").agg(
        F.count(F.lit(1)).alias("steps"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.min("loss").alias("least_loss"), F.round(F.avg("loss"), 4).alias("mean_loss"),
        F.round((F.min_by("loss", "step") - F.max_by("loss", "step")) / F.min_by("loss", "step") * 100, 4).alias("reduction_pct"),
        F.round(F.avg(F.when(F.col("speed") > 0, F.col("speed"))), 4).alias("mean_speed"), F.max(F.when(F.col("memory") > 0, F.col("memory"))).alias("most_memory"),
    )


def trailing(steps: DataFrame, window: int = 20) -> DataFrame:
    """(run, step, average): mean of up to `window` losses ending here; a run of fewer steps keeps its losses."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(1 - window, 0)
    return steps.select("run", "step", F.round(F.when(F.count(F.lit(1)).over(Window.partitionBy("run")) < window, F.col("loss")).otherwise(F.avg("loss").over(w)), 6).alias("average"))


def whole_windows(steps: DataFrame, window: int = 20) -> DataFrame:
    """(run, step, average): mean of the `window` losses that begin here, where there are as many."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(0, window - 1)
    return steps.select("run", "step", F.avg("loss").over(w).alias("a"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == window).select("run", "step", F.round("a", 6).alias("average"))


def running_best(steps: DataFrame) -> DataFrame:
    """(run, step, best, improved): least loss so far, and whether this step lowered it."""
    w = Window.partitionBy("run").orderBy("step")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return steps.select("run", "step", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), (before.isNull() | (F.col("loss") < before)).alias("improved"))


def sampled(steps: DataFrame, width: int = 60) -> DataFrame:
    """(run, step, loss) of `width` evenly spaced steps of each run, or all of fewer."""
    w = Window.partitionBy("run")
    rows = steps.withColumn("_i", F.row_number().over(w.orderBy("step")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    nth = F.floor((F.col("_i") * width + F.col("_n") - 1) / F.col("_n"))
    return rows.where((F.col("_n") <= width) | ((F.floor(nth * F.col("_n") / width) == F.col("_i")) & (nth < width))).select("run", "step", "loss")


def memory_gb(batch: Column, sequence: Column, rank: Column) -> Column:
    """Estimated memory of a plan."""
    gb = float(1 << 30)
    return F.lit(4.0) + batch * sequence * F.lit(4096.0 * 32 * 2) / gb + rank * F.lit(4096.0 * 32 * 2 * 2) / gb


def plans(spark, limit_gb: float = 16.0, margin: float = 0.15) -> DataFrame:
    """The parameter grid that fits the memory: one plan for each effective batch, sequence and rank, scored and ranked."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (512, 1024, 2048)))).alias("seq"))
    for name, values in (("batch", (1, 2, 4)), ("accum", (1, 2, 4, 8)), ("rank", (8, 16))):
        grid = grid.crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name)))
    rows = grid.withColumn("memory_gb", F.round(memory_gb(F.col("batch"), F.col("seq"), F.col("rank")), 4)).withColumn("effective", F.col("batch") * F.col("accum")).where(F.col("memory_gb") <= limit_gb * (1 - margin))
    first = F.row_number().over(Window.partitionBy("effective", "seq", "rank").orderBy("batch"))
    rows = rows.withColumn("_r", first).where("_r = 1").drop("_r").withColumn("speed", F.col("batch") / F.col("seq") * F.lit(1024.0))
    room = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) - F.col("memory_gb") / limit_gb) / margin))
    all_ = Window.partitionBy()
    score = F.lit(0.3) * F.col("speed") / F.max("speed").over(all_) + F.lit(0.4) * room + F.lit(0.3) * F.sqrt(F.col("effective") / F.max("effective").over(all_))
    scored = rows.withColumn("score", F.round(score, 6))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("effective"), F.desc("seq"), "rank")))


def fallbacks(configs: DataFrame) -> DataFrame:
    """(id, attempt, eval_batch, batch, seq, layers): what each out-of-memory event in turn changes, until nothing is left to lower.

    First the evaluation batch, then the batch, then the sequence (to multiples of 256, 512 at least),
    then the layers (4 at least); each is halved, so no more often than it has binary digits.
    """
    kind = "array<struct<eval_batch:int,batch:int,seq:int,layers:int>>"
    names = ("eval_batch", "batch", "seq", "layers")
    now = {n: f"element_at(s, -1).{n}" for n in names}

    def row(**changed: str) -> str:
        return "named_struct(" + ", ".join(f"'{n}', cast({changed.get(n, now[n])} AS int)" for n in names) + ")"

    next_ = f"""CASE WHEN {now["eval_batch"]} > 1 THEN {row(eval_batch=f"{now['eval_batch']} div 2")} WHEN {now["batch"]} > 1 THEN {row(batch=f"{now['batch']} div 2")}
        WHEN {now["seq"]} > 512 THEN {row(seq=f"greatest(512, {now['seq']} div 2 div 256 * 256)")} WHEN {now["layers"]} > 4 THEN {row(layers=f"greatest(4, {now['layers']} div 2)")} END"""
    first = "named_struct(" + ", ".join(f"'{n}', {n}" for n in names) + ")"
    steps = " + ".join(f"length(bin(coalesce({n}, 0)))" for n in names)
    chain = f"aggregate(sequence(1, {steps}), cast(array({first}) AS {kind}), (s, i) -> CASE WHEN ({next_}) IS NULL THEN s ELSE cast(concat(s, array({next_})) AS {kind}) END)"
    rows = configs.select("id", F.posexplode(F.expr(chain)).alias("attempt", "c"))
    return rows.select("id", "attempt", "c.*")


def tier(rows: DataFrame, tiers: DataFrame, column: str) -> DataFrame:
    """Range join with a small table of half-open tiers (low, high, name)."""
    return rows.join(F.broadcast(tiers), (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")))


def latest(runs: DataFrame, by: str) -> DataFrame:
    """The latest run of each base, ties by the greater run, marked by whether it is the latest of all."""
    order = [F.desc("started_at"), F.desc("run")]
    rows = runs.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")
    return rows.withColumn("recommended", F.row_number().over(Window.orderBy(*order)) == 1)
