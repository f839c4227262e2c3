"""Event-count buckets, closes, and quantile bins.

Sums and closes of a bucket come from one two-phase aggregation (the close is the row of the bucket's last
``seq``); only the bucket table, b times smaller, meets a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..series import by_session


@by_session
def bucketed(rows: DataFrame, bucket: int, sums: tuple[str, ...] = (), closes: tuple[str, ...] = (), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, bucket, sums (unknown counts as 0) and closes (kept unknown) of the full buckets of ``bucket`` rows."""
    if bucket < 1:
        raise ValueError(f"bucket must be at least 1, not {bucket}")
    at = rows.withColumn("bucket", F.floor(F.col("seq") / bucket))
    out = at.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in sums],
        *[F.max_by(c, "seq").alias(f"{c}_close") for c in closes],
    )
    return out.filter(F.col("__n") == bucket).drop("__n")


def mid_change(close: str = "mid_close", by: tuple[str, ...] = ("symbol",)) -> Column:
    """Log change of a bucket's close from the close before; NULL if either is unknown or not positive."""
    log_close = B.log_or_null(F.col(close))
    return log_close - F.lag(log_close).over(Window.partitionBy(*by).orderBy("bucket"))


@by_session
def with_changes(buckets: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``change`` (over this bucket) and ``next_change`` (over the next one)."""
    w = Window.partitionBy(*by).orderBy("bucket")
    return buckets.withColumn("change", mid_change(by=by)).withColumn("next_change", F.lead("change").over(w))


def quantile_edges(rows: DataFrame, column: str, n_bins: int) -> list[float]:
    """Distinct exact quantiles (linear between order statistics) at n_bins + 1 even points."""
    points = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    found = rows.agg(F.array_sort(F.array_distinct(F.percentile(column, points))).alias("edges")).first()["edges"]
    return [float(x) for x in found or []]


def bin_of(column: str, edges: list[float]) -> Column:
    """Bin number by half-open inner edges, in 0 .. len(edges) - 2."""
    inner = edges[1:-1]
    at = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= F.col(column))) if inner else F.lit(0)
    return F.least(at, F.lit(max(0, len(edges) - 2)))


def binned(rows: DataFrame, x: str, y: str, n_bins: int, least: int = 1) -> DataFrame:
    """bin, x_mean, y_mean, y_se, n of quantile bins of x that hold at least ``least`` rows."""
    edges = quantile_edges(rows, x, n_bins)
    grouped = rows.withColumn("bin", bin_of(x, edges)).groupBy("bin").agg(
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), (F.stddev_samp(y) / F.sqrt(F.count(F.lit(1)))).alias("y_se"), F.count(F.lit(1)).alias("n")
    )
    return grouped.filter(F.col("n") >= least)
