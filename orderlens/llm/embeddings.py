"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``LONG`` nearest reference points (pivots) in order. It is posted in the
inverted lists of the first ``ROUTE`` of them. Within a list, vectors that share at least ``SHARED`` of
their described pivots are candidates, and candidates are verified by the cosine in double precision. A pair
that meets in several lists counts in that of its smallest common pivot only.

Identical vectors are one class with a count. A list over ``SPLIT`` vectors is split by a second described pivot:
candidates share another pivot besides that of the list, so splitting loses none, and a pair counts in the list of its
smallest such pivot only. What is long even so (vectors that are truly alike) is dealt in blocks by a hash, and a task gets two
blocks: no task holds a whole list, however hot, and what leaves a task is a count and one link for each vector, not the pairs.

Pivots are vectors of the data, and both are taken from the sample's mean, so that no pivot is everyone's neighbour: their number grows with the root of the number of vectors, the
first ``SPREAD`` are chosen farthest-first in a sample, whatever the data's mean or clusters, and the rest are further
sampled vectors that are no near duplicates of them. They are broadcast, ``PIVOT_BYTES`` at most. Every vector is indexed.
Recall on vectors at a cosine of 0.95 and over is measured by tests against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
vectors of different lengths don't link; repeated rows link with each other and share a component; a row with
a null vec_id takes part, and its component is the smallest id reachable, if any. An empty table gives no rows.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Cosine of a link.
LEAST = 0.95
#: Pivots that describe a vector, those whose lists hold it, and shared ones that make a candidate.
LONG, ROUTE, SHARED = 12, 6, 2
#: Pivots: so many times the root of the number of vectors, and so many at least; bytes of their broadcast at most; those that
#: are chosen farthest-first, from twice as many.
PIVOTS_PER_ROOT, PIVOTS_LEAST, PIVOT_BYTES, SPREAD = 4, 64, 1 << 27, 2048
#: Vectors of a list beyond which it is split by a second pivot.
SPLIT = 8192
#: Rows of a block: a sixteenth of a list, within bounds.
BLOCK_LEAST, BLOCK_MOST = 256, 4096


def usable(embedding) -> np.ndarray | None:
    """The unit vector in double precision, or None."""
    if embedding is None or len(embedding) == 0 or any(x is None for x in embedding):
        return None
    x = np.asarray(embedding, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``n`` sampled unit vectors: the first, then always the one that is farthest from those taken; no near duplicates."""
    taken, nearest = [0], sample @ sample[0]
    while len(taken) < n:
        row = int(nearest.argmin())
        if nearest[row] >= LEAST:
            break
        taken.append(row)
        np.maximum(nearest, sample @ sample[row], out=nearest)
    return np.array(taken)


def pivots_of(vectors: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(centre, pivots) by vector length, from a sample of the vectors in the order of a hash."""
    most = int(max(PIVOTS_PER_ROOT * n**0.5, PIVOTS_LEAST))
    longest = vectors.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 1
    most = max(2, min(most, PIVOT_BYTES // (8 * max(1, longest))))
    sample = common.hash_sample(vectors.filter("embedding is not null"), ["vec_id", "embedding"], most + SPREAD).collect()
    by_length: dict[int, list[np.ndarray]] = {}
    for row in sample:
        x = usable(row["embedding"])
        if x is not None:
            by_length.setdefault(len(x), []).append(x)
    out = {}
    for k, v in by_length.items():
        units = np.array(v)
        centre = units.mean(axis=0)
        units = units - centre
        size = np.sqrt((units * units).sum(axis=1, keepdims=True))
        units = units / np.where(size > 0, size, 1.0)
        head, rest = units[: 2 * SPREAD], units[2 * SPREAD :]
        pivots = head[farthest_first(head, min(most, SPREAD))]
        for a in range(0, len(rest), 1024):  # further ones, as long as there is room
            part = rest[a : a + 1024]
            pivots = np.concatenate([pivots, part[(part @ pivots.T).max(axis=1) < LEAST]])
        out[k] = centre, pivots[:most]
    return out


def described(vectors: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id, code (of identical vectors; null: unusable), unit (bytes of doubles), near (pivots, nearest first)."""
    spread = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = spread.value
        for batch in batches:
            codes, raws, near = [], [], []
            for e in batch.column("embedding").to_pylist():
                x = usable(e)
                if x is None:
                    codes.append(None), raws.append(None), near.append(None)
                    continue
                raw = x.tobytes()
                codes.append(hashlib.blake2b(np.asarray(e, np.float64).tobytes(), digest_size=16).digest())
                raws.append(raw)
                own = pivots.get(len(x))
                if own is None:
                    near.append([-len(x)])
                    continue
                s = own[1] @ (x - own[0])
                top = np.argpartition(-s, min(LONG, len(s) - 1))[:LONG] if len(s) > LONG else np.arange(len(s))
                near.append(top[np.lexsort((top, -s[top]))].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.binary()), pa.array(raws, pa.binary()), pa.array(near, pa.list_(pa.int32()))], ["vec_id", "code", "unit", "near"])

    return vectors.mapInArrow(run, "vec_id long, code binary, unit binary, near array<int>")


def _joined(least: float):
    def join(key: tuple, group: pa.Table) -> pa.Table:
        """Links within a block or between two, of the pairs whose smallest common pivot (and second one) is this list's."""
        pivot, second, i, j = (x.as_py() for x in key)
        codes, copies, sides = group.column("code").to_pylist(), group.column("copies").to_numpy(), group.column("side").to_numpy()
        near = [np.array(x) for x in group.column("near").to_pylist()]
        units = group.column("unit").to_pylist()
        links, root = np.zeros(len(codes), np.int64), list(range(len(codes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        columns = {p: c for c, p in enumerate(sorted({p for x in near for p in x.tolist()}))}
        long, before = np.zeros((len(codes), len(columns)), np.float32), np.zeros((len(codes), len(columns)), np.float32)
        for r, x in enumerate(near):
            long[r, [columns[p] for p in x.tolist()]] = 1
            earlier = [p for p in x[:ROUTE].tolist() if p < pivot]
            if second >= 0:  # in a split list, also those of smaller second pivots
                earlier += [p for p in x.tolist() if p < second and p != pivot]
            before[r, [columns[p] for p in earlier]] = 1
        need = np.minimum(SHARED, np.array([len(x) for x in near]))
        size = np.array([len(x) for x in units])
        a_rows = np.flatnonzero(sides == i)
        b_rows = a_rows if i == j else np.flatnonzero(sides == j)
        for a0 in range(0, len(a_rows), 1024):
            a = a_rows[a0 : a0 + 1024]
            candidate = (long[a] @ long[b_rows].T >= need[a][:, None]) & (before[a] @ before[b_rows].T == 0) & (size[a][:, None] == size[b_rows][None, :])
            if i == j:
                candidate &= a[:, None] < b_rows[None, :]
            for n_bytes in np.unique(size[a]):
                x, y = a[size[a] == n_bytes], b_rows[size[b_rows] == n_bytes]
                if not len(x) or not len(y):
                    continue
                cosine = np.frombuffer(b"".join([units[r] for r in x])).reshape(len(x), -1) @ np.frombuffer(b"".join([units[r] for r in y])).reshape(len(y), -1).T
                hit = (cosine >= least) & candidate[np.ix_(size[a] == n_bytes, size[b_rows] == n_bytes)]
                links[x] += hit @ copies[y]
                links[y] += hit.T @ copies[x]
                for r, row in zip(x, hit, strict=True):
                    if row.any():
                        for c in y[row].tolist():
                            p, q = find(int(r)), find(c)
                            if p != q:
                                root[max(p, q)] = min(p, q)
        some = np.flatnonzero(links)
        return pa.table({"code": pa.array([codes[r] for r in some], pa.binary()), "links": pa.array(links[some]), "root": pa.array([codes[find(int(r))] for r in some], pa.binary())})

    return join


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = common.table(described(vectors, pivots_of(vectors, vectors.count())), "described")
    classes = rows.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"), F.first("unit").alias("unit"), F.first("near").alias("near"))
    classes = common.table(classes, "classes")
    posted = classes.select("code", "copies", "unit", "near", F.explode(F.slice("near", 1, ROUTE)).alias("pivot"))
    lists = classes.select(F.explode(F.slice("near", 1, ROUTE)).alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    hot = common.table(lists.filter(F.col("size") > SPLIT).select("pivot", F.lit(True).alias("hot")), "hot-lists")
    also = F.when(F.col("hot") & (F.size("near") >= SHARED), F.array_remove("near", F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    parted = lambda df: df.join(common.bounded_broadcast(hot), "pivot", "left").withColumn("second", F.explode(also)).drop("hot")
    lists = parted(classes.select("near", F.explode(F.slice("near", 1, ROUTE)).alias("pivot"))).groupBy("pivot", "second").agg(F.count(F.lit(1)).alias("size"))
    block = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.col("size") / 16))
    lists = common.bounded_broadcast(common.table(lists.filter("size > 1").select("pivot", "second", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "lists"))
    posted = parted(posted).join(lists, ["pivot", "second"]).withColumn("side", F.pmod(F.xxhash64("code"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = posted.withColumn("other", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    dealt = dealt.select("pivot", "second", "i", "j", "side", "code", "copies", "unit", "near")
    found = common.table(dealt.groupBy("pivot", "second", "i", "j").applyInArrow(_joined(least), "code binary, links long, root binary"), "found")
    counts = found.groupBy("code").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("code").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("code", "copies", "least_id").join(counts, "code", "left").join(roots.withColumnRenamed("node", "code"), "code", "left")
    grouped = common.table(grouped.select("code", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "code").alias("root")), "grouped")
    ids = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_class = grouped.join(ids, "root").select("code", "n_links", "component_id")
    out = rows.select("vec_id", "code").join(per_class, "code", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
