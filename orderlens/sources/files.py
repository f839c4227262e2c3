"""Message and order-book files, derived CSVs, and sinks.

Files have no header and one row per event; the n-th message belongs to the n-th book row. Rows get a
``seq`` by their place in the file, without sorting or gathering the file: each split counts its rows, and a
small table of counts gives each split its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

#: {symbol}_{session}_{start}_{end}_{kind}_{levels}.csv
NAME = r"([^/_]+)_(\d{4}-\d{2}-\d{2})_\d+_\d+_(message|orderbook)_(\d+)\.csv$"


def raw_path(folder: str, symbol: str, session: str, kind: str, levels: int = 10) -> str:
    """Where a file of the public sample layout lies."""
    if kind not in ("message", "orderbook"):
        raise ValueError(f"kind must be message or orderbook, not {kind}")
    return f"{folder}/{symbol}_{session}_34200000_57600000_{kind}_{levels}.csv"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with ``file`` and 0-based ``seq`` in the order of the file."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    splits = placed.groupBy("file", "__split").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "__split", (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(splits, ["file", "__split"]).withColumn("seq", F.col("__id") + F.col("__shift")).drop("__split", "__id", "__shift")


def _keyed(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("symbol", F.regexp_extract("file", NAME, 1)).withColumn("session", F.regexp_extract("file", NAME, 2))
    return named.withColumn("symbol", F.when(F.col("symbol") == "", F.col("file")).otherwise(F.col("symbol"))).drop("file")


def _cells(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The first cells of each line as text, which a strict cast reads; lines may have more."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in schema.fieldNames()])).option("header", False).csv(path)


def _strict(field: T.StructField, empty: bool = True) -> Column:
    """A cell as a value; one that isn't of the column's type fails, and so does an empty one unless it is let through."""
    cell = F.col(field.name)
    value = cell.try_cast(field.dataType)
    bad = F.raise_error(F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), F.coalesce(cell, F.lit("empty")))).cast(field.dataType)
    return F.when((cell.isNull() & F.lit(empty)) | value.isNotNull(), value).otherwise(bad).alias(field.name)


def read_messages(spark: SparkSession, path: str | list[str], validate: bool = True) -> DataFrame:
    """Events of message files (a path, glob or list): the first six columns; further ones are ignored.

    A cell that isn't of its column's type fails the read; an empty one is a fault that ``validate`` raises.
    """
    events = _keyed(numbered(_cells(spark, path, S.MESSAGE_SCHEMA))).select("symbol", "session", "seq", *map(_strict, S.MESSAGE_SCHEMA))
    return S.validate_events(events) if validate else events


def read_orderbook(spark: SparkSession, path: str | list[str], levels: int) -> DataFrame:
    """Book rows of order-book files, the first ``levels`` levels; only those columns are parsed, strictly."""
    schema = S.book_schema(levels)
    return _keyed(numbered(_cells(spark, path, schema))).select("symbol", "session", "seq", *[_strict(f, empty=False) for f in schema])


def aligned(events: DataFrame, book: DataFrame) -> DataFrame:
    """Events with their book rows; a ValueError if the two don't have the same rows."""
    keys = [k for k in ("symbol", "session", "seq") if k in events.columns and k in book.columns]
    counts = lambda df: df.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("n"))
    off = counts(events).join(counts(book).withColumnRenamed("n", "m"), keys[:-1], "full").filter(~F.col("n").eqNullSafe(F.col("m"))).collect()
    if off:
        raise ValueError(f"messages and book rows differ: {[tuple(r) for r in off]}")
    return events.join(book, keys)


def to_lake(df: DataFrame, path: str) -> None:
    """Parquet partitioned by symbol (and session), each file in ``seq`` order: what later reads prune and window by."""
    keys = [k for k in ("symbol", "session") if k in df.columns]
    df.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").write.partitionBy(*keys).parquet(path)


FAMILY_CSV = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("point", T.DoubleType()), T.StructField("ci_low", T.DoubleType()),
    T.StructField("ci_high", T.DoubleType()), T.StructField("p_raw", T.DoubleType()), T.StructField("p_adj", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    T.StructField("n_obs", T.LongType()), T.StructField("horizon", T.DoubleType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A derived CSV with a header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small result table as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, n: int = 100) -> str:
    """A result table as console text."""
    return df._jdf.showString(n, 60, False)
