"""Bootstraps: replicates are rows of a range, dealt to tasks; each has a random stream of its own.

A replicate's stream is seeded by (seed, replicate), so results don't depend on partitions or attempts. The
resampled series is sent to every worker, so its length is checked against a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import BOOTSTRAP_BLOCK_EVENTS, BOOTSTRAP_N_RESAMPLES, CI_LEVEL, MASTER_SEED
from ..schema import EstimationResult
from .estimators import auc

#: Values of a series that may be sent to workers.
SERIES_ROWS = 20_000_000
METHODS = ("stationary", "circular", "iid")


def circular_index(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Wrapped blocks of a fixed length from uniform starts, cut to n."""
    starts = rng.integers(0, n, size=-(-n // block))
    return np.add.outer(starts, np.arange(block)).ravel()[:n] % n


def stationary_index(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Wrapped blocks of geometric length with mean ``block``."""
    restart = rng.random(n) < 1.0 / block
    restart[0] = True
    at = np.flatnonzero(restart)
    starts = rng.integers(0, n, size=len(at))
    whose = np.cumsum(restart) - 1
    return (starts[whose] + np.arange(n) - at[whose]) % n


def index_of(method: str, n: int, block: int | None, rng: np.random.Generator) -> np.ndarray:
    if method == "iid" or block is None:
        return rng.integers(0, n, size=n)
    return (circular_index if method == "circular" else stationary_index)(n, block, rng)


def replicates(spark: SparkSession, data: np.ndarray, statistic: Callable[[np.ndarray], float], *, method: str, block: int | None, n_resamples: int, seed: int) -> DataFrame:
    """(replicate, value): the statistic of each resample of the rows of ``data``; NULL where it is unknown."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if len(data) > SERIES_ROWS:
        raise ValueError(f"{len(data)} rows are too many to resample in workers; {SERIES_ROWS} at most")
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = shared.value
        for ids in batches:
            values = [statistic(data[index_of(method, len(data), block, np.random.default_rng([seed, int(i)]))]) for i in ids["id"]]
            yield pd.DataFrame({"replicate": ids["id"], "value": [None if v is None or not np.isfinite(v) else float(v) for v in values]})

    tasks = max(1, min(n_resamples, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n_resamples, 1, tasks).mapInPandas(run, "replicate long, value double")


def percentile_interval(values: DataFrame, ci_level: float = CI_LEVEL) -> tuple[float | None, float | None, float | None, int]:
    """(low, high, standard error, number) of known replicate values; linear between order statistics."""
    tail = (1 - ci_level) / 2
    row = values.agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).first()
    low, high = row["q"] if row["q"] else (None, None)
    return low, high, row["s"], row["n"]


def _series(rows: DataFrame, columns: list[str], order: str) -> np.ndarray:
    n = rows.count()
    if n > SERIES_ROWS:
        raise ValueError(f"{n} rows are too many to resample in workers; {SERIES_ROWS} at most")
    return rows.orderBy(order).select(*columns).toPandas().to_numpy(np.float64)


def block_bootstrap_ci(
    rows: DataFrame, columns: str | list[str], statistic: Callable[[np.ndarray], float], *, name: str, metric: str = "autocorr", order: str = "row",
    block: int = BOOTSTRAP_BLOCK_EVENTS, n_resamples: int = BOOTSTRAP_N_RESAMPLES, ci_level: float = CI_LEVEL, seed: int = MASTER_SEED, method: str = "stationary",
) -> EstimationResult:
    """Percentile interval of any statistic of an ordered series (an array; rows by columns if several)."""
    if method not in METHODS[:2]:
        raise ValueError(f"method must be stationary or circular, not {method!r}")
    data = _series(rows, [columns] if isinstance(columns, str) else columns, order)
    data = data[:, 0] if isinstance(columns, str) else data
    values = replicates(rows.sparkSession, data, statistic, method=method, block=block, n_resamples=n_resamples, seed=seed)
    low, high, se, _ = percentile_interval(values, ci_level)
    return EstimationResult(name, metric, float(statistic(data)), low, high, len(data), se, None, ci_level, f"block_bootstrap_{method}", extra={"block": block, "n_resamples": n_resamples})


def rank_auc(pairs: np.ndarray) -> float:
    """AUC of (rank code of the score, label) rows from counts; NaN with one class."""
    code, positive = pairs[:, 0].astype(np.int64), pairs[:, 1] == 1
    ups = np.bincount(code[positive], minlength=int(code.max()) + 1).astype(np.float64)
    downs = np.bincount(code[~positive], minlength=len(ups)).astype(np.float64)
    p, q = ups.sum(), downs.sum()
    return float("nan") if not p or not q else float((ups * (np.cumsum(downs) - downs / 2)).sum() / (p * q))


def auc_ci(
    rows: DataFrame, score: str, label: str, *, name: str, order: str = "row", n_resamples: int = BOOTSTRAP_N_RESAMPLES, ci_level: float = CI_LEVEL,
    seed: int = MASTER_SEED, block: int | None = None, method: str = "stationary",
) -> EstimationResult:
    """AUC with a paired bootstrap interval and a two-sided p-value against 0.5 (never under 1 / (resamples + 1))."""
    if block is not None and method not in METHODS[:2]:
        raise ValueError(f"method must be stationary or circular, not {method!r}")
    bad = rows.filter(F.col(label).isNull() | ~F.col(label).isin(0, 1)).limit(1).count()
    point = None if bad else auc(rows, score, label)
    if point is None:
        raise ValueError("AUC needs labels 0 and 1, both present")
    data = _series(rows, [score, label], order)
    pairs = np.column_stack([np.unique(data[:, 0], return_inverse=True)[1], data[:, 1]])
    kind = "iid" if block is None else method
    values = replicates(rows.sparkSession, pairs, rank_auc, method=kind, block=block, n_resamples=n_resamples, seed=seed).filter("value is not null").cache()
    low, high, se, n = percentile_interval(values, ci_level)
    tails = values.agg(F.avg((F.col("value") <= 0.5).cast("double")).alias("a"), F.avg((F.col("value") >= 0.5).cast("double")).alias("b")).first()
    values.unpersist()
    p = min(1.0, max(2 * min(tails["a"], tails["b"]), 1 / (n + 1))) if n else None
    how = "bootstrap_paired" if block is None else f"bootstrap_block_{method}"
    return EstimationResult(name, "AUC", point, low, high, len(data), se if n > 1 else None, p, ci_level, how, extra={"n_resamples_effective": n, "block": block})
