"""What the training-data operators share: the shared folder, tables that cut lineage, checked broadcasts.

Nothing here collects rows that grow with the corpus: counts are aggregates, and tables go through the
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor loses nothing.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows stay at or under this bound.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of its own only where unset in local mode, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_orderlens_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="orderlens-")
        spark.sparkContext._orderlens_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/orderlens/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _parquet_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of Parquet files with nothing but columns and filters over it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def row_numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of each row, the same in every scan, and the name of that column, which no other has.

    A number is the place of the row's file among the files, and the row's place in the file. Numbers by partitions
    (``monotonically_increasing_id``) won't do where a table is scanned twice: its splits follow from the cores that the
    cluster has at that time. What isn't a scan of Parquet files is written to a table first.
    """
    spark, name = df.sparkSession, "__orderlens_row"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    if not _parquet_scan(df):
        df = table(df, "rows")
    meta = df.metadataColumn("_metadata")
    place, file = meta["row_index"], f"{name}_file"
    paths = sorted(r[0] for r in df.select(meta["file_path"]).distinct().collect())
    if len(paths) < 2:
        return df.select("*", place.alias(name)), name
    files = spark.createDataFrame(list(enumerate(paths)), f"{name}_at long, {file} string")
    own = df.select("*", place.alias(name), meta["file_path"].alias(file)).join(bounded_broadcast(files), file)
    return own.withColumn(name, F.shiftleft(f"{name}_at", 40) + F.col(name)).drop(file, f"{name}_at"), name


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows, else as it is.

    ``df`` should be a written table (``table``), so that counting it is cheap. Beyond the bound the join
    is a shuffled one, whose skewed keys AQE splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those of the smallest hash of ``columns``.

    Rows far beyond the n-th are dropped by a bound on the hash first, so that tasks send the driver about 2 n rows
    together and not n rows each.
    """
    spot = F.xxhash64(*columns, F.lit(17))
    total = df.count()
    if total > 2 * n:
        df = df.filter(spot < int(2**63 * (4 * n / total - 1)))
    return df.withColumn("__spot", spot).orderBy("__spot").limit(n).drop("__spot")


def dealt_sample(df: DataFrame, by: str, columns: list[str], n: int) -> DataFrame:
    """At most ``n`` rows dealt over the values of ``by``: of each, as many as all can have, and one at least.

    The values come from a count over all rows. Of each value the rows of the smallest hash of ``columns`` are taken;
    rows far beyond them are dropped by a bound on the hash before anything is shuffled.
    """
    counts = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    left, share = n, 1
    for i, size in enumerate(sorted(counts.values())):
        share = max(1, left // (len(counts) - i))
        if size > share:
            break
        left -= size
    whole = 2**63 - 1
    bounds = [(k, whole if size <= 2 * share + 40 else int(2**63 * (2 * (2 * share + 40) / size - 1))) for k, size in counts.items()]
    kept = F.broadcast(df.sparkSession.createDataFrame(bounds, "__by string, __bound long"))
    near = df.withColumn("__spot", F.xxhash64(*columns, F.lit(17))).join(kept, (F.col(by) == F.col("__by")) & (F.col("__spot") <= F.col("__bound")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__spot"))
    return near.withColumn("__rank", rank).filter(F.col("__rank") <= share).drop("__by", "__bound", "__spot", "__rank")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder or file in the shared store."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = uri[5:]
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def release() -> None:
    """Gives the memory that a worker has freed back to the system: workers outlive their tasks, and others wait beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tasks(spark: SparkSession) -> int:
    """Tasks to deal small work items to: a few for each core that the session has."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)
