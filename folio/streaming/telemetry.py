"""Structured Streaming forms of the telemetry and feedback operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import telemetry


def steps(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def latest(stream: DataFrame) -> DataFrame:
    """The last step of each run so far (complete mode)."""
    return stream.groupBy("run").agg(F.max("step").alias("step"), F.max_by("loss", "step").alias("loss"))


def windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; events later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed log lines of a folder of text files, as they arrive."""
    return telemetry.parsed(spark.readStream.text(path).select(F.col("value").alias("line")))


def joined(sessions: DataFrame, ratings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Ratings with their session's text; sessions are forgotten after `late`."""
    one = sessions.withWatermark("ts", late).alias("s")
    two = ratings.withWatermark("rated_at", late).alias("r")
    return two.join(one, F.expr(f"r.session_id = s.session_id AND r.rated_at >= s.ts AND r.rated_at <= s.ts + INTERVAL {late}"))


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is available now, as a table in memory (for tests and small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)
