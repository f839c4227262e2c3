"""Order flow and touch books derived from the ``events`` table, in Spark and in DuckDB SQL.

The table is no market data; its columns are read as messages so that every operator has rows to work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENT_COLUMNS, NO_ASK, NO_BID


def keyed(spark: SparkSession, sf_dir: str, sessions: bool = False) -> DataFrame:
    """events with symbol (and session), seq and k; only the columns that are used reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    symbol = F.concat(F.lit("S"), F.col("user_id") % 5)
    e = e.withColumn("symbol", symbol)
    if sessions:
        e = e.withColumn("session", F.concat(F.lit("D"), F.floor(F.col("user_id") / 5) % 2))
    seq = F.row_number().over(Window.partitionBy(*keys_of(e)).orderBy("event_id")) - 1
    return e.withColumn("seq", seq.cast("long")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def keys_of(e: DataFrame) -> list[str]:
    return [c for c in ("symbol", "session") if c in e.columns]


def order_flow(spark: SparkSession, sf_dir: str, sessions: bool = False) -> DataFrame:
    """symbol (session), seq and the message columns."""
    e = keyed(spark, sf_dir, sessions)
    kind = F.col("event_type")
    code: Column = F.when(kind.isin("view", "signup"), 1).when(kind == "click", 2).when(kind == "error", 3).when(F.col("event_id") % 4 == 0, 5).otherwise(4)
    side = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = e.select(
        *keys_of(e), "seq", seconds.alias("time_s"), code.cast("byte").alias("event_type"), F.col("user_id").alias("order_id"),
        F.greatest(F.lit(1), F.floor("value")).cast("long").alias("size"), (1_000_000 - side * 100 * (1 + F.col("k") % 7)).cast("long").alias("price"), side.cast("byte").alias("direction"),
    )
    return rows.select(*keys_of(e), "seq", *EVENT_COLUMNS)


def touch_book(spark: SparkSession, sf_dir: str, sessions: bool = False) -> DataFrame:
    """symbol (session), seq and one level of quotes, now and then empty on a side."""
    e, k = keyed(spark, sf_dir, sessions), F.col("k")
    no_ask, no_bid = F.col("event_id") % 97 == 0, F.col("event_id") % 101 == 0
    return e.select(
        *keys_of(e), "seq",
        F.when(no_ask, NO_ASK).otherwise(1_000_000 + 100 * (1 + F.floor(k / 4) % 3)).cast("long").alias("ask_px_1"),
        F.when(no_ask, 0).otherwise(1 + (7 * k) % 300).cast("long").alias("ask_sz_1"),
        F.when(no_bid, NO_BID).otherwise(1_000_000 - 100 * (1 + k % 4)).cast("long").alias("bid_px_1"),
        F.when(no_bid, 0).otherwise(1 + F.floor("value")).cast("long").alias("bid_sz_1"),
    )


#: In SQL, a symbol's session is part of its key, after a bar.
SESSION_KEY = ("'S' || (user_id % 5)", "'S' || (user_id % 5) || '|D' || (user_id // 5 % 2)")


#: The same as common table expressions.
KEYED_SQL = r"""keyed as (select *, 'S' || (user_id % 5) as symbol, cast(regexp_extract(props, '"k":\s*(\d+)', 1) as bigint) as k from events),
numbered as (select *, row_number() over (partition by symbol order by event_id) - 1 as seq from keyed)"""

FLOW_SQL = KEYED_SQL + r""",
flow as (select symbol, seq, epoch_us(ts) / 1e6::double as time_s,
  cast(case when event_type in ('view', 'signup') then 1 when event_type = 'click' then 2 when event_type = 'error' then 3 when event_id % 4 = 0 then 5 else 4 end as tinyint) as event_type,
  user_id as order_id, cast(greatest(1, floor(value)) as bigint) as size,
  cast(1000000 - (case when k % 2 = 0 then 1 else -1 end) * 100 * (1 + k % 7) as bigint) as price, cast(case when k % 2 = 0 then 1 else -1 end as tinyint) as direction from numbered)"""

TOUCH_SQL = f"""touch as (select symbol, seq,
  cast(case when event_id % 97 = 0 then {NO_ASK} else 1000000 + 100 * (1 + (k // 4) % 3) end as bigint) as ask_px_1, cast(case when event_id % 97 = 0 then 0 else 1 + (7 * k) % 300 end as bigint) as ask_sz_1,
  cast(case when event_id % 101 = 0 then {NO_BID} else 1000000 - 100 * (1 + k % 4) end as bigint) as bid_px_1, cast(case when event_id % 101 = 0 then 0 else 1 + floor(value) end as bigint) as bid_sz_1 from numbered)"""
