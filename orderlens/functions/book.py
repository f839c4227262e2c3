"""Column expressions over event and book rows; unknown is NULL, and everything stays in the JVM."""

from __future__ import annotations

import re
from functools import reduce
from math import erfc, sqrt
from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import EXECUTIONS, NO_ASK, NO_BID


def rows_of(*by: str, order: str = "seq") -> WindowSpec:
    """Rows of a symbol (or other keys) in order."""
    return Window.partitionBy(*(by or ("symbol",))).orderBy(order)


def touch_present() -> Column:
    """Whether both best quotes exist."""
    return (F.col("ask_px_1") != NO_ASK) & (F.col("bid_px_1") != NO_BID)


def mid() -> Column:
    return F.when(touch_present(), (F.col("ask_px_1") + F.col("bid_px_1")) / 2.0)


def spread() -> Column:
    return F.when(touch_present(), (F.col("ask_px_1") - F.col("bid_px_1")).cast("double"))


def queue_imbalance() -> Column:
    """(bid - ask) / (bid + ask) size at the touch; a one-sided book gives 1 or -1, an empty one NULL."""
    bid, ask = F.col("bid_sz_1"), F.col("ask_sz_1")
    return (bid - ask) / F.nullif(bid + ask, F.lit(0))


def depth(columns: list[str]) -> Column:
    """All displayed size, of the levels among ``columns``."""
    sizes = [F.col(c) for c in columns if re.fullmatch(r"(ask|bid)_sz_\d+", c)]
    return reduce(lambda a, b: a + b, sizes).cast("double")


def is_execution() -> Column:
    return F.col("event_type").isin(*EXECUTIONS)


def trade_sign() -> Column:
    """The initiator's side: direction is that of the resting order."""
    return -F.col("direction").cast("int")


def signed_size() -> Column:
    """Executed size signed by its initiator; 0 for other messages."""
    return F.when(is_execution(), -F.col("direction").cast("long") * F.col("size")).otherwise(F.lit(0)).cast("double")


def ofi(w: WindowSpec) -> Column:
    """Order-flow imbalance of a row against the row before; both comparisons hold at an equal price."""
    b, q, a, r = (F.col(c) for c in ("bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1"))
    b0, q0, a0, r0 = (F.lag(x).over(w) for x in (b, q, a, r))
    both = touch_present() & F.coalesce(F.lag(touch_present()).over(w), F.lit(False))
    bid = F.when(b >= b0, q).otherwise(0) - F.when(b <= b0, q0).otherwise(0)
    ask = F.when(a >= a0, r0).otherwise(0) - F.when(a <= a0, r).otherwise(0)
    return F.when(both, (bid + ask).cast("double"))


def tick_sign(by: str = "symbol") -> Column:
    """Tick-rule sign at executions, from the last price change among them; NULL elsewhere and before one."""
    trades = Window.partitionBy(by, is_execution()).orderBy("seq")
    move = F.nullif(F.signum(F.col("price") - F.lag("price").over(trades)), F.lit(0.0))
    return F.when(is_execution(), move)


def carried(change: Column, by: str = "symbol") -> Column:
    """The last known value among executions up to a row; NULL at other rows."""
    trades = Window.partitionBy(by, is_execution()).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.when(is_execution(), F.last(change, ignorenulls=True).over(trades))


def size_at(side: str, price: Column, levels: int, of=F.col) -> Column:
    """Displayed size at a price on one side of the row's book; NULL if not displayed."""
    return F.coalesce(*[F.when(of(f"{side}_px_{i}") == price, of(f"{side}_sz_{i}")) for i in range(1, levels + 1)])


def log_or_null(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def round_tick(price: Column, tick: int) -> Column:
    """To the grid, halves to even."""
    return (F.bround(price / tick, 0) * tick).cast("long")


def critical(ci_level: float) -> float:
    """Two-sided normal quantile."""
    return NormalDist().inv_cdf(0.5 + ci_level / 2)


def normal_p(z: float) -> float:
    """Two-sided normal p-value, accurate far out."""
    return erfc(abs(z) / sqrt(2))
