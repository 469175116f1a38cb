"""Length distributions by order statistics and counts over thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def distribution(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """n, least, most, mean and the order statistics at the whole part of n times a share, from 0.

    Counts by value make the shuffle as small as the distinct values, not the rows.
    """
    keys = [by] if by else []
    counts = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("k"))
    rows = counts.groupBy(*keys).agg(
        F.sum("k").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.sum(F.col(column) * F.col("k")) / F.sum("k"), 4).alias("mean"),
        F.array_sort(F.collect_list(F.struct(F.col(column).cast("long").alias("v"), "k"))).alias("h"),
    )
    at = lambda q: F.expr(f"aggregate(h, named_struct('c', 0L, 'v', cast(null AS bigint)), (s, x) -> named_struct('c', s.c + x.k, 'v', CASE WHEN s.v IS NULL AND s.c + x.k > cast(floor(n * {q}D) AS bigint) THEN x.v ELSE s.v END)).v")
    return rows.select(*keys, "n", "least", "most", "mean", *(at(q).alias(name) for name, q in SHARES))


def over(values: DataFrame, column: str, limits: tuple[int, ...] = (512, 1024, 2048, 4096)) -> DataFrame:
    """One row: how many values exceed each limit, and the percentage beyond the second."""
    return values.agg(*(F.count_if(F.col(column) > x).alias(f"over_{x}") for x in limits), F.round(F.count_if(F.col(column) > limits[1]) / F.count(F.lit(1)) * 100, 4).alias("truncated_pct"))
