"""Point-in-time features and forward labels, one shared window over a symbol's rows.

A symbol's history can be cut in chunks so that one long history isn't one task: each chunk is a window
partition of its own, with copies of the few rows before and after it that its features and labels look at
(``with_halo``). The tick sign looks back without bound; its chunks get the last known sign of the chunks
before through a small table with one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import book as B
from ..registry import HORIZON_GRID_EVENTS
from ..schema import column_spec
from ..series import by_session

RV_WINDOW = 20


def with_halo(df: DataFrame, chunk: int, back: int, ahead: int) -> DataFrame:
    """Rows with ``chunk`` (number) and ``own``; those near a border also as copies in the neighbour, not own."""
    home = F.floor(F.col("seq") / chunk)
    near = F.sequence(F.floor(F.greatest(F.col("seq") - ahead, F.lit(0)) / chunk), F.floor((F.col("seq") + back) / chunk))
    out = df.withColumn("__home", home).withColumn("chunk", F.explode(near))
    return out.withColumn("own", F.col("chunk") == F.col("__home")).drop("__home")


class PointInTimeFeatureEngine:
    """Six backward features and one label for each horizon."""

    def __init__(self, horizons: tuple[int, ...] = HORIZON_GRID_EVENTS, rv_window: int = RV_WINDOW) -> None:
        if rv_window < 1:
            raise ValueError(f"rv_window must be at least 1, not {rv_window}")
        self.horizons, self.rv_window = tuple(horizons), rv_window

    def specs(self) -> list[T.StructField]:
        return [
            column_spec("ofi", "order-flow imbalance at the touch against the row before"),
            column_spec("queue_imbalance", "bid less ask size over their sum at the touch"),
            column_spec("tick_sign", "tick-rule sign of an execution"),
            column_spec("depth", "displayed size of all levels"),
            column_spec("spread", "ask less bid price at the touch"),
            column_spec(f"rv_{self.rv_window}", f"realised volatility of {self.rv_window} mid returns"),
            *(column_spec(f"fwd_ret_{h}", f"log mid return over the next {h} events", horizon=h) for h in self.horizons),
        ]

    @by_session
    def compute(self, events: DataFrame, book: DataFrame, chunk: int | None = None) -> DataFrame:
        """symbol, seq, mid and a column for each spec, carrying the spec as its metadata."""
        missing = [c for c in ("ask_px_1", "ask_sz_1", "bid_px_1", "bid_sz_1") if c not in book.columns]
        if missing:
            raise ValueError(f"the book lacks {missing}")
        sizes = [c for c in book.columns if c.startswith(("ask_", "bid_"))]
        rows = events.select("symbol", "seq", "event_type", "price").join(book.select("symbol", "seq", *sizes), ["symbol", "seq"])
        rows = rows.withColumn("mid", B.mid()).withColumn("depth", B.depth(sizes))
        keys: tuple[str, ...] = ("symbol",)
        if chunk is not None:
            rows, keys = with_halo(rows, chunk, back=self.rv_window, ahead=max(self.horizons, default=0)), ("symbol", "chunk")
        w = Window.partitionBy(*keys).orderBy("seq")
        log_mid = B.log_or_null(F.col("mid"))
        rows = rows.withColumn("ofi", B.ofi(w)).withColumn("queue_imbalance", B.queue_imbalance()).withColumn("spread", B.spread())
        rows = rows.withColumn("__r", log_mid - F.lag(log_mid).over(w))
        trail = w.rowsBetween(1 - self.rv_window, 0)
        squares = F.sum(F.col("__r") * F.col("__r")).over(trail)
        rows = rows.withColumn(f"rv_{self.rv_window}", F.when(F.count("__r").over(trail) == self.rv_window, F.sqrt(squares)))
        for h in self.horizons:
            rows = rows.withColumn(f"fwd_ret_{h}", F.lead(log_mid, h).over(w) - log_mid)
        if chunk is not None:
            rows = rows.filter("own")
        rows = tick_signs(rows, chunk)
        return rows.select("symbol", "seq", "mid", *[self._described(s) for s in self.specs()])

    @staticmethod
    def _described(spec: T.StructField) -> Column:
        return F.col(spec.name).alias(spec.name, metadata=spec.metadata)


@by_session
def tick_signs(rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """Adds ``tick_sign``: the sign of the last price change among executions, NULL elsewhere and before one."""
    if chunk is None:
        changed = rows.withColumn("__move", B.tick_sign())
        return changed.withColumn("tick_sign", B.carried(F.col("__move"))).drop("__move")
    if "chunk" not in rows.columns:
        rows = rows.withColumn("chunk", F.floor(F.col("seq") / chunk))
    trades = rows.filter(B.is_execution())
    # what a chunk hands on: its last price, and its last sign given the price before it
    inside = Window.partitionBy("symbol", "chunk").orderBy("seq")
    move = F.nullif(F.signum(F.col("price") - F.lag("price").over(inside)), F.lit(0.0))
    ends = trades.withColumn("__move", move).groupBy("symbol", "chunk").agg(
        F.min_by("price", "seq").alias("first_px"), F.max_by("price", "seq").alias("last_px"), F.max_by("__move", F.when(F.col("__move").isNotNull(), F.col("seq"))).alias("last_move")
    )
    over = Window.partitionBy("symbol").orderBy("chunk")
    ends = ends.withColumn("before_px", F.lag("last_px").over(over))
    ends = ends.withColumn("entry", F.nullif(F.signum(F.col("first_px") - F.col("before_px")), F.lit(0.0)))
    ends = ends.withColumn("before_sign", F.last(F.coalesce("last_move", "entry"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(ends.select("symbol", "chunk", "entry", "before_sign"), ["symbol", "chunk"], "left")
    w = Window.partitionBy("symbol", "chunk", B.is_execution()).orderBy("seq")
    step = F.nullif(F.signum(F.col("price") - F.lag("price").over(w)), F.lit(0.0))
    marked = marked.withColumn("__move", F.coalesce(F.when(F.row_number().over(w) == 1, F.col("entry")), step))
    held = F.last("__move", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("tick_sign", F.when(B.is_execution(), F.coalesce(held, F.col("before_sign")))).drop("entry", "before_sign", "__move")


@by_session
def tick_accuracy(events: DataFrame) -> DataFrame:
    """symbol, n_graded, accuracy of the tick rule against the true initiator (NULL without graded trades)."""
    known = tick_signs(events).filter(F.col("tick_sign").isNotNull())
    graded = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_graded"), F.avg((F.col("tick_sign") == B.trade_sign()).cast("double")).alias("accuracy"))
    return events.select("symbol").distinct().join(graded, "symbol", "left").select("symbol", F.coalesce("n_graded", F.lit(0)).alias("n_graded"), "accuracy")


@by_session
def primitives(events: DataFrame, book: DataFrame) -> DataFrame:
    """What the studies read: symbol, seq, mid, ofi, signed_size, tick_sign, queue_imbalance; one window pass."""
    w = B.rows_of("symbol")
    rows = events.select("symbol", "seq", "event_type", "size", "price", "direction").join(book.select("symbol", "seq", "ask_px_1", "ask_sz_1", "bid_px_1", "bid_sz_1"), ["symbol", "seq"])
    rows = rows.withColumn("mid", B.mid()).withColumn("ofi", B.ofi(w)).withColumn("signed_size", B.signed_size()).withColumn("queue_imbalance", B.queue_imbalance())
    return tick_signs(rows).select("symbol", "seq", "mid", "ofi", "signed_size", "tick_sign", "queue_imbalance")
