"""Sinks: JSON lines, dated and resumable appends, splits, preference exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One row a line, UTF-8, nulls kept; never over what is there."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def dated(df: DataFrame, path: str, timestamp: str) -> None:
    """Append by UTC day."""
    df.withColumn("dt", F.date_format(timestamp, "yyyyMMdd")).write.mode("append").partitionBy("dt").json(path)


def resumed(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the file has not; how many those were."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti")
    before = spark.read.schema(df.schema).parquet(path).count() if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else 0
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def splits(df: DataFrame, path: str) -> None:
    """One folder for each value of `split`."""
    df.write.mode("errorifexists").partitionBy("split").option("ignoreNullFields", False).json(path)


def preferences(pairs: DataFrame, form: str) -> DataFrame:
    """The pairs as `full`, `columns` (prompt, chosen, rejected) or `array` (one pretty JSON text)."""
    if form == "full":
        return pairs
    three = pairs.select("prompt", "chosen", "rejected")
    if form == "columns":
        return three
    if form == "array":
        return three.agg(F.to_json(F.array_sort(F.collect_list(F.struct("prompt", "chosen", "rejected")))).alias("json"))
    raise ValueError(f"no such form: {form}")


def report(row: dict, title: str) -> str:
    """A Markdown table of one row of statistics."""
    return "\n".join([f"# {title}", "", "| Measure | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in row.items())]) + "\n"


def audit(df: DataFrame, column: str) -> DataFrame:
    """Short hash and length in place of a text."""
    return df.withColumn("hash", F.substring(F.sha2(column, 256), 1, 16)).withColumn("length", F.length(column)).drop(column)
