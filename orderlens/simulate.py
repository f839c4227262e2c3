"""Seeded order flow with known ground truth.

All random numbers of a stream are drawn as arrays, from a generator seeded by the master seed, the offset and the
stream's seed. A pressure that reverts to 0 tilts the side of each event; the action is drawn by its shares. What is
sequential is the two resting queues alone: they bound what an event can take and are renewed when empty. Prices
follow from the flow that the queues let through. A stream is a task, and the same wherever it is made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import accumulate, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .registry import MASTER_SEED
from .schema import EVENT_COLUMNS, EventType

OPEN_S, MEAN_WAIT_S = 34200.0, 1e-3


@dataclass(frozen=True, slots=True)
class SimConfig:
    """Parameters; prices and ticks in 1/10000 of a dollar."""

    beta: float = 0.0
    sigma: float = 8e-5
    p0: int = 300_000
    tick: int = 100
    ar_phi: float = 0.5
    ar_sigma: float = 1.0
    base_queue: int = 200
    exec_prob: float = 0.25
    cancel_prob: float = 0.35
    mean_order: int = 100
    seed_offset: int = 0


def through_queues(kind: np.ndarray, rest: np.ndarray, wanted: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each event and the resting order it works on: a queue gives no more than it has, a cancel leaves 1."""
    size, order = wanted.copy(), np.empty(len(kind), np.int64)
    left, name, names = {1: base, -1: base}, {1: 1, -1: 2}, count(3)
    for i, (k, side) in enumerate(zip(kind.tolist(), rest.tolist(), strict=True)):
        order[i] = name[side]
        if k == EventType.SUBMIT:
            left[side] += int(size[i])
            continue
        size[i] = min(int(size[i]), left[side] - (k == EventType.CANCEL_PARTIAL))
        left[side] -= int(size[i])
        if not left[side]:
            left[side], name[side] = base, next(names)
    return size, order


def stream(config: SimConfig, n_events: int, seed: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Event columns and truth columns (driver, mid, fwd_ret_1) of one stream."""
    if n_events < 2:
        raise ValueError(f"n_events must be at least 2, not {n_events}")
    rng = np.random.default_rng([MASTER_SEED + config.seed_offset, int(seed)])
    kicks, noise = config.ar_sigma * rng.standard_normal(n_events), config.sigma * rng.standard_normal(n_events)
    pressure = np.fromiter(accumulate(kicks, lambda p, kick: config.ar_phi * p + kick), float, n_events)
    side = np.where(rng.random(n_events) < 1.0 / (1.0 + np.exp(-pressure)), 1, -1)
    kind = rng.choice([EventType.EXECUTE_VISIBLE, EventType.CANCEL_PARTIAL, EventType.SUBMIT], n_events, p=[config.exec_prob, config.cancel_prob, 1 - config.exec_prob - config.cancel_prob])
    rest = np.where(kind == EventType.EXECUTE_VISIBLE, -side, side)  # an execution takes from the other side
    scale = float(max(config.mean_order, 1))
    size, order = through_queues(kind, rest, 1 + rng.geometric(1.0 / scale, n_events), config.base_queue)
    driver = side * np.where(kind == EventType.SUBMIT, 1.0, -1.0) * size / scale
    moves = config.beta * driver + noise
    mid = config.p0 * np.exp(np.cumsum(moves) - moves)
    bid = config.tick * np.round(mid / config.tick - 0.5).astype(np.int64)
    columns = (kind, order, size, np.where(rest == 1, bid, bid + config.tick), rest)
    events = {"time_s": OPEN_S + np.cumsum(rng.exponential(MEAN_WAIT_S, n_events)), **dict(zip(EVENT_COLUMNS[1:], columns, strict=True))}
    return events, {"driver": driver, "mid": mid, "fwd_ret_1": np.append(np.diff(np.log(mid)), np.nan)}


OUTPUT = "beta double, seed long, seq long, time_s double, event_type byte, order_id long, size long, price long, direction byte, driver double, mid double, fwd_ret_1 double"


def simulate(spark: SparkSession, n_events: int, seeds: Sequence[int], betas: Sequence[float] = (0.0,), config: SimConfig | None = None) -> DataFrame:
    """Events with their truth, for each beta and seed: a task for each stream."""
    base = config or SimConfig()
    jobs = spark.createDataFrame([(float(b), int(s)) for b in betas for s in seeds], "beta double, seed long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in batches:
            for beta, seed in jobs.itertuples(index=False):
                events, truth = stream(replace(base, beta=beta), n_events, seed)
                out = pd.DataFrame({"beta": beta, "seed": seed, "seq": np.arange(n_events), **events, **truth})
                out["fwd_ret_1"] = out["fwd_ret_1"].astype(object).where(out["fwd_ret_1"].notna(), None)
                yield out

    return jobs.repartition(min(len(betas) * len(seeds), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, OUTPUT)


class OrderFlowSimulator:
    """Streams of one configuration as tables."""

    def __init__(self, spark: SparkSession, config: SimConfig | None = None) -> None:
        self.spark, self.config = spark, config or SimConfig()

    def generate_with_truth(self, n_events: int, seed: int) -> DataFrame:
        if n_events < 2:
            raise ValueError(f"n_events must be at least 2, not {n_events}")
        return simulate(self.spark, n_events, [seed], [self.config.beta], self.config)

    def generate(self, n_events: int, seed: int) -> DataFrame:
        return self.generate_with_truth(n_events, seed).selectExpr("'SIM' as symbol", "seq", *EVENT_COLUMNS)
