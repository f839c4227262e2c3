"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Each source has a weight schedule over training time 0 to 1, given by knots and linear between them.
Its integral is the source's cumulative share of its own target; a document whose words begin after ``c``
of the source's target ``T`` gets the time at which the integral reaches ``c / T``. Documents are then
range-sorted by that position. A source is consumed in the order of a hash of the document id; what a
target has beyond the source's size is a second pass in the same order.

Prefix sums run in two levels (hash buckets of a source, then rows of a bucket), the bucket count growing
as the square root of a source's rows, so no task holds a whole source.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null doc_id
is hashed as the empty string; rows that repeat a doc_id are rows of their own and tie by size; an empty
table gives no rows. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of sources in their order, repeating; words wanted and words of a source at most, both by sizes.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: (time, weight) knots of sources in their order, repeating: falling, level, rising late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: Rows of a hash bucket at least.
BUCKET_ROWS = 256
#: What parts words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def integrated(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """Segments (time, weight, slope, integral before, whole integral) of a schedule."""
    total = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for a, b in zip(knots, knots[1:]):
        out.append((a[0], a[1], (b[1] - a[1]) / (b[0] - a[0]), done, total))
        done += (a[1] + b[1]) / 2 * (b[0] - a[0])
    return out


def time_sql(share: str, kind: str, schedules=SCHEDULES) -> str:
    """SQL for the time at which a schedule's integral reaches ``share`` of its whole; ``kind`` says which schedule."""
    cases = []
    for k, knots in enumerate(schedules):
        arms = []
        for t, w, m, before, total in reversed(integrated(knots)):
            r = f"({share} * {total!r}D - {before!r}D)"
            arms.append(f"when {share} * {total!r}D >= {before!r}D then {t!r}D + 2.0D * {r} / ({w!r}D + sqrt({w!r}D * {w!r}D + 2.0D * {m!r}D * {r}))")
        cases.append(f"when {kind} = {k} then (case {' '.join(arms)} end)")
    return f"(case {' '.join(cases)} end)"


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, the hash that orders a source, and the columns to keep."""
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, kinds: int = len(SCHEDULES)) -> DataFrame:
    """Adds weight, kind and target to a row for each source with source_size.

    A target is the least of weight * level and cap * size, for the level at which they sum to the share:
    the fixed point of resharing by weight what capped sources leave. The level follows from prefix sums
    over sources in the order in which they reach their cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = by_source.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    ranked = ranked.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(full), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))).over(every)["level"])
    return ranked.select(
        "source", "source_size", "n_docs", (F.col("at") % kinds).alias("kind"),
        F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"),
    )


def mixed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, again_at for each row, range-sorted by position.

    ``taken`` words are the whole document, a part, none, or up to twice its size; ``position`` is the time of the
    document's first pass (null: not taken) and ``again_at`` that of its second (null: none).
    """
    rows = common.table(sized(docs, *keep), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = common.bounded_broadcast(common.table(targets(by_source), "targets").withColumnRenamed("source", "of"))
    n_buckets = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("n_docs")))
    part = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["of"])).withColumn("bucket", F.floor(part * n_buckets / F.lit(2.0**32)))
    rows = rows.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    before = rows.groupBy("of", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("of", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("of", "bucket").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(before, ["of", "bucket"]).withColumn("c", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    whole = F.floor("target")
    rows = rows.withColumn("first", F.greatest(F.lit(0), F.least("size", whole - F.col("c")))).withColumn("second", F.greatest(F.lit(0), F.least("size", whole - F.col("source_size") - F.col("c"))))
    rows = rows.withColumn("x", F.col("c") / F.nullif("target", F.lit(0.0))).withColumn("y", (F.col("source_size") + F.col("c")) / F.nullif("target", F.lit(0.0)))
    return rows.select(
        *keep, "doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).cast("long").alias("taken"),
        F.when(F.col("first") > 0, F.round(F.expr(time_sql("x", "kind")), 9)).alias("position"),
        F.when(F.col("second") > 0, F.round(F.expr(time_sql("y", "kind")), 9)).alias("again_at"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in training order, with their columns: one for each pass that takes some of its words."""
    own, row = common.row_numbered(docs)
    at = f"{row}_at"
    passes = mixed(own, row).select(row, F.explode(F.array_compact(F.array("position", "again_at"))).alias(at))
    passes = common.bounded_broadcast(common.table(passes, "passes"), 500_000)
    return own.join(passes, row).orderBy(at, row).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the default weights."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _plain(sql: str) -> str:
    return sql.replace("D ", " ").replace("D)", ")").replace("D*", "*")


ORACLE = {
    "op1_mixing": rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as hash from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as place from d group by source),
w as (select *, cast(case place % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight, source_size * 2.0::double as most from s),
f as (select *, most / weight as ratio, sum(source_size) over () * 1.5::double - coalesce(sum(most) over p, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over p, 0) as heavy from w
    window p as (order by most / weight, place rows between unbounded preceding and 1 preceding)),
g as (select rest / heavy as level from f where rest / heavy <= ratio order by ratio, place limit 1),
t as (select w.source, w.source_size, w.place % 3 as kind, least(most, weight * level) as target from w, g),
c as (select d.doc_id, d.size, t.source_size, t.target, t.kind, sum(d.size) over (partition by d.source order by d.hash, d.size rows unbounded preceding) - d.size as c
    from d join t on d.source is not distinct from t.source),
e as (select *, greatest(0, least(size, floor(target)::bigint - c)) as first, greatest(0, least(size, floor(target)::bigint - source_size - c)) as second,
    c / nullif(target, 0) as x, (source_size + c) / nullif(target, 0) as y from c)
select doc_id, size, source_size, target, cast(first + second as bigint) as taken,
  case when first > 0 then round({_plain(time_sql("x", "kind"))}, 9) end as position,
  case when second > 0 then round({_plain(time_sql("y", "kind"))}, 9) end as again_at
from e
"""
}
