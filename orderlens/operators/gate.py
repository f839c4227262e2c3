"""Evidence that the machinery works: replay against shown books, and recovery of a planted effect."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.book import critical
from ..registry import CI_LEVEL
from ..series import by_session
from ..simulate import SimConfig, stream
from . import book as K

BETAS, N_EVENTS, N_SEEDS, LAGS = (0.0, 3e-4, 6e-4), 20_000, 40, 5


@by_session
def reconstruct(events: DataFrame, book: DataFrame, levels: int) -> DataFrame:
    """A row for each symbol: transition invariant, seeded matches, and the match rate of the replay from events alone."""
    names = K.book_columns(levels)
    joined = K.both(K.replay(events, levels), book, levels)
    cells = sum(((F.col(c) == F.col(f"ref_{c}")).cast("int") for c in names), F.lit(0)) / float(len(names))
    alone = joined.groupBy("symbol").agg(F.avg(K._same(range(1, levels + 1)).cast("double")).alias("message_only_row_match"), F.avg(cells).alias("message_only_cell_match"))
    return K.transition_invariant(events, book, levels).join(K.seeded_match(events, book, levels), "symbol").join(alone, "symbol")


def slope_hac(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[float, float]:
    """Slope and its autocorrelation-robust error for one in-memory series, by scores of the centred regressor."""
    x = x - x.mean()
    slope = float(x @ y / (x @ x))
    z = x * (y - y.mean() - slope * x)
    meat = float(z @ z) + 2 * sum((1 - k / (lags + 1)) * float(z[k:] @ z[:-k]) for k in range(1, lags + 1))
    return slope, float(np.sqrt(meat)) / float(x @ x)


RECOVERED = "beta double, seed long, point double, ci_low double, ci_high double"


def recover(spark: SparkSession, betas: Sequence[float] = BETAS, n_events: int = N_EVENTS, seeds: Sequence[int] = tuple(range(1, N_SEEDS + 1)), lags: int = LAGS, config: SimConfig | None = None) -> DataFrame:
    """The estimate of the planted effect and its interval for each beta and seed; a task for each stream."""
    base, z = config or SimConfig(), critical(CI_LEVEL)
    jobs = spark.createDataFrame([(float(b), int(s)) for b in betas for s in seeds], "beta double, seed long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in batches:
            out = []
            for beta, seed in jobs.itertuples(index=False):
                _, truth = stream(replace(base, beta=beta), n_events, seed)
                point, se = slope_hac(truth["driver"][:-1], truth["fwd_ret_1"][:-1], lags)
                out.append((beta, seed, point, point - z * se, point + z * se))
            yield pd.DataFrame(out, columns=["beta", "seed", "point", "ci_low", "ci_high"])

    return jobs.repartition(min(len(betas) * len(seeds), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, RECOVERED)


def recovery_curve(recovered: DataFrame) -> DataFrame:
    """beta, mean_estimate, ci_coverage, reject_rate (interval leaves out 0), n_seeds."""
    within = lambda x: (F.col("ci_low") <= x) & (x <= F.col("ci_high"))
    return recovered.groupBy("beta").agg(
        F.avg("point").alias("mean_estimate"), F.avg(within(F.col("beta")).cast("double")).alias("ci_coverage"),
        F.avg((~within(F.lit(0.0))).cast("double")).alias("reject_rate"), F.count(F.lit(1)).alias("n_seeds"),
    )
