"""What a replacement of a part has to offer; structural types over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .operators.folds import Fold
from .schema import EstimationResult


@runtime_checkable
class Replayer(Protocol):
    """Books from events: a row of the best levels after every event."""

    def __call__(self, events: DataFrame, levels: int) -> DataFrame: ...


@runtime_checkable
class Simulator(Protocol):
    """Seeded events; the same seed gives the same rows."""

    def generate(self, n_events: int, seed: int) -> DataFrame: ...


@runtime_checkable
class Features(Protocol):
    """Columns over aligned events and book rows, and what each column is."""

    def specs(self) -> Sequence[T.StructField]: ...

    def compute(self, events: DataFrame, book: DataFrame) -> DataFrame: ...


@runtime_checkable
class Estimator(Protocol):
    """One effect of x on y with its interval."""

    def estimate(self, rows: DataFrame, x: str | list[str], y: str, name: str) -> EstimationResult: ...


@runtime_checkable
class Splitter(Protocol):
    """Folds, as bounds, of n ordered rows."""

    def split(self, n: int, label_horizon: int = 1, embargo: int = 0) -> Sequence[Fold]: ...


@runtime_checkable
class Controller(Protocol):
    """Results of one family with adjusted p-values and decisions."""

    def control(self, results: Sequence[EstimationResult], family_id: str = "", alpha: float = 0.05) -> list[EstimationResult]: ...
