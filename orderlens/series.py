"""One key for a series of rows: a symbol and, where tables have one, a session.

Rows are numbered from 0 within a file, so a symbol's sessions each have a row 0. Operators window and join by
``(symbol, seq)``; ``by_session`` lets them take tables of several sessions by making symbol and session one value
on the way in and two columns again on the way out. It costs one string per row and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between a symbol and a session; a control character, which names don't hold.
BETWEEN = "\x1f"


def joined(df: DataFrame) -> DataFrame:
    """``df`` with symbol and session as one value in ``symbol``."""
    return df.withColumn("symbol", F.concat(F.coalesce("symbol", F.lit("")), F.lit(BETWEEN), F.coalesce("session", F.lit("")))).drop("session")


def parted(df: DataFrame) -> DataFrame:
    """``df`` with the columns symbol, session, and then the others."""
    both = F.split("symbol", BETWEEN)
    return df.select(both[0].alias("symbol"), both[1].alias("session"), *[F.col(c) for c in df.columns if c != "symbol"])


def by_session(operator: Callable) -> Callable:
    """The operator for tables with a session as well: each session of a symbol is a series of its own.

    Tables without a session pass through. A ValueError if only some of the tables that have a symbol have a session.
    """

    @wraps(operator)
    def run(*args, **kwargs):
        keyed = [x for x in (*args, *kwargs.values()) if isinstance(x, DataFrame) and "symbol" in x.columns]
        having = ["session" in x.columns for x in keyed]
        if not any(having):
            return operator(*args, **kwargs)
        if not all(having):
            raise ValueError("some tables have a session and others don't")
        one = lambda x: joined(x) if any(x is k for k in keyed) else x
        out = operator(*[one(x) for x in args], **{k: one(x) for k, x in kwargs.items()})
        return parted(out) if isinstance(out, DataFrame) and "symbol" in out.columns else out

    return run
