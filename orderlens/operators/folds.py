"""Purged, embargoed folds as bounds, and audits for leakage.

A fold is a row of bounds, never a list of rows: its test block is [test_lo, test_hi), its training rows are
those before ``train_end`` or from ``train_from`` on. Rows meet the bounds by a range condition on a table of
a few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import CV_EMBARGO_EVENTS, CV_N_FOLDS
from ..schema import is_causal, is_label

MODES = ("walkforward", "purged_kfold")


@dataclass(frozen=True, slots=True)
class Fold:
    """Test rows [test_lo, test_hi); training rows [0, train_end) and [train_from, n)."""

    fold: int
    n: int
    test_lo: int
    test_hi: int
    train_end: int
    train_from: int

    @property
    def n_train(self) -> int:
        return self.train_end + self.n - self.train_from

    @property
    def n_test(self) -> int:
        return self.test_hi - self.test_lo


class PurgedWalkForwardSplitter:
    """Contiguous test blocks, with training rows kept ``max(horizon, embargo)`` away."""

    def __init__(self, n_folds: int = CV_N_FOLDS, mode: str = "walkforward") -> None:
        if n_folds < 2:
            raise ValueError(f"n_folds must be at least 2, not {n_folds}")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        self.n_folds, self.mode = n_folds, mode

    def split(self, n: int, label_horizon: int = 1, embargo: int = CV_EMBARGO_EVENTS) -> list[Fold]:
        """Folds of n rows; blocks without rows and folds without training rows are left out."""
        if n < 1 or label_horizon < 0 or embargo < 0:
            raise ValueError("n must be positive, and label_horizon and embargo not negative")
        gap = max(label_horizon, embargo)
        edges = np.linspace(0, n, self.n_folds + 1).astype(int).tolist()
        out = []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            after = n if self.mode == "walkforward" else min(n, hi + gap)
            fold = Fold(i, n, lo, hi, max(0, lo - gap), after)
            if hi > lo and fold.n_train:
                out.append(fold)
        return out

    def bounds(self, spark: SparkSession, counts: dict[str, int], label_horizon: int = 1, embargo: int = CV_EMBARGO_EVENTS) -> DataFrame:
        """The folds of each symbol as a table."""
        rows = [(s, f.fold, f.n, f.test_lo, f.test_hi, f.train_end, f.train_from) for s, n in counts.items() if n for f in self.split(n, label_horizon, embargo)]
        return spark.createDataFrame(rows, "symbol string, fold int, n long, test_lo long, test_hi long, train_end long, train_from long")


def members(rows: DataFrame, bounds: DataFrame, row: str = "row") -> DataFrame:
    """Rows with fold and part ('test' or 'train'); a row is in several folds' training parts."""
    at = F.col(row)
    test = (at >= F.col("test_lo")) & (at < F.col("test_hi"))
    train = (at < F.col("train_end")) | (at >= F.col("train_from"))
    joined = rows.join(bounds, "symbol").filter(test | train)
    return joined.withColumn("part", F.when(test, "test").otherwise("train"))


def label_overlaps(train: DataFrame, test_lo, test_hi, label_horizon: int, row: str = "row"):
    """Condition: a training row's label window [row, row + horizon] meets the block [test_lo, test_hi] (closed)."""
    return (F.col(row) + label_horizon >= test_lo) & (F.col(row) <= test_hi)


def embargo_breaches(test_lo, test_hi, embargo: int, row: str = "row"):
    """Condition: a training row lies within ``embargo`` of the block on either side."""
    at = F.col(row)
    return ((at >= test_lo - embargo) & (at < test_lo)) | ((at > test_hi) & (at <= test_hi + embargo))


def future_features(specs: Iterable[T.StructField]) -> list[str]:
    """Names of features, not labels, that look ahead."""
    return [s.name for s in specs if not is_label(s) and not is_causal(s)]


def future_columns(df: DataFrame) -> list[str]:
    """The same from the metadata of a feature table."""
    return future_features(df.schema.fields)


FINDINGS = "kind string, fold int, count long, detail string"


def audit(spark: SparkSession, parts: DataFrame, label_horizon: int, embargo: int, specs: Sequence[T.StructField] = (), row: str = "row") -> DataFrame:
    """Findings over rows with fold and part, one row for each kind and fold that has any; empty means clean.

    Where the rows have a symbol, rows are numbered within it: blocks and findings are those of a symbol and fold.
    """
    by = [c for c in ("symbol", "fold") if c in parts.columns]
    blocks = parts.filter("part = 'test'").groupBy(*by).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    train = parts.filter("part = 'train'").join(blocks, by)
    found = train.groupBy(*by).agg(
        F.count_if(label_overlaps(train, F.col("lo"), F.col("hi"), label_horizon, row)).alias("label_overlap"),
        (F.count_if(embargo_breaches(F.col("lo"), F.col("hi"), embargo, row)) if embargo else F.lit(0).cast("long")).alias("embargo_breach"),
    )
    rows = found.select(*by, F.expr("stack(2, 'label_overlap', label_overlap, 'embargo_breach', embargo_breach) as (kind, count)")).filter("count > 0")
    of = [x for c in by for x in (F.lit(f" of {c} " if c == by[0] else f", {c} "), F.col(c))]
    rows = rows.select(*by[:-1], "kind", "fold", "count", F.concat(F.col("count"), F.lit(" training rows reach the test block"), *of).alias("detail"))
    ahead = future_features(specs)
    extra = spark.createDataFrame([("future_feature", None, len(ahead), ",".join(ahead))] if ahead else [], FINDINGS)
    return rows.unionByName(extra, allowMissingColumns=True)


def audit_fold(fold: Fold, label_horizon: int, embargo: int, specs: Sequence[T.StructField] = ()) -> list[tuple[str, int]]:
    """The same for a fold by its bounds alone: (kind, count) of each breach."""
    last = fold.test_hi - 1
    before = lambda lo: max(0, fold.train_end - max(0, lo))  # noqa: E731  training rows of the first part from lo on
    overlap = before(fold.test_lo - label_horizon) + max(0, min(fold.n, fold.test_hi) - fold.train_from)
    breach = before(fold.test_lo - embargo) + max(0, min(fold.n, last + embargo + 1) - fold.train_from) if embargo else 0
    found = [("label_overlap", overlap), ("embargo_breach", breach), ("future_feature", len(future_features(specs)))]
    return [x for x in found if x[1]]
