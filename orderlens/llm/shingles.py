"""N-gram Jaccard join by chosen paths.

A text is the set of its hashed word shingles. In each run, a set chooses the members whose hash, salted by
the run, is small enough that 1 / (LAMBDA * size) of them pass; sets that choose the same member meet in a
bucket. A pair at the threshold shares one chosen member or more on average in a run (one where sizes differ by a quarter, the
least), so r runs miss e^-r of such pairs at most, and runs are repeated until ``RECALL`` is reached. A bucket over ``LIMIT`` whose sets are not alike on the whole is split
again by members chosen with the path so far as salt, and so on; others are brute-forced by 64-byte sketches,
which drop what is clearly apart. Sets that a chain of such candidate pairs joins form a group, and within a group all pairs
are compared exactly, by the number of shared shingles. Candidates, then, only have to join groups: no list
of pairs is made, and what leaves a task is a count and a link for each set.

Texts with equal sets are one class with a count. Buckets and groups are dealt to tasks in blocks by a hash, two
blocks to a task, so no task holds a whole hot one; large groups are first cut by size, as sets whose sizes differ by more
than a quarter can't be links.

Defined results: null text counts as empty; texts without words form one class; a text of fewer words than a
shingle has one shingle, of all its words; a null doc_id takes part; repeated rows are rows each and link.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components
from .licenses import Hashes, rolled, words_of
from .pieces import mixed64
from .tokens import texts_of

#: Words of a shingle; similarity of a link as a fraction.
K, OVER, UNDER = 5, 4, 5
#: Chosen members: one in LAMBDA times the size; target recall at the threshold, and the runs that it takes; sets in a bucket
#: that is brute-forced; levels of splitting.
LAMBDA, RECALL, LIMIT, DEPTH = 0.8, 0.9995, 4096, 12
RUNS = math.ceil(-math.log(1 - RECALL))
#: Mean similarity of a bucket's sets from which it is not split, as splitting would only lose links of near copies.
DENSE = 0.2
#: Bins of a sketch; agreement that keeps a pair; sets under so many members are kept whatever their sketches say.
BINS, AGREE, SMALL = 64, 0.55, 16
#: Sets in a block; members that one product of incidence matrices takes; ratio of sizes in a step, a little over
#: UNDER / OVER, so that rounding can't part the sets of a link by two steps.
BLOCK, COLUMNS, STEP = 256, 4096, 1.26


def shingle_set(words: list[bytes], kept: Hashes, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    n = min(k, len(words))
    grams = rolled(*kept.of(words), n)[0].view(np.uint64)
    return np.unique(mixed64(grams + np.uint64(n)))


def sketch(members: np.ndarray) -> bytes:
    """A byte for each bin of the hash space: 0 if empty, else of the smallest member in it."""
    out = np.zeros(BINS, np.uint8)
    bins = (members >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = 1 + (members[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def chosen(members: np.ndarray, salt: int, rate: float = LAMBDA) -> np.ndarray:
    """Paths to which a set goes on from the path ``salt``."""
    if not len(members):
        return np.zeros(0, np.uint64)
    h = mixed64(members ^ np.uint64(salt))
    most = 2.0**64 / (rate * len(members))
    return mixed64(h + np.uint64(salt | 1))[h <= np.uint64(min(most, 2.0**64 - 2048))]


def salts(runs: int) -> list[int]:
    return [int(x) for x in mixed64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def _signer(k: int, runs: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Hashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                keys, sizes, sketches, paths = [], [], [], []
                for text in part.column("text").to_pylist():
                    members = shingle_set(words_of(text), kept, k)
                    keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                    sizes.append(len(members))
                    sketches.append(sketch(members))
                    paths.append(np.unique(np.concatenate([chosen(members, s) for s in salts(runs)])).view(np.int64))
                cuts = np.cumsum([0, *map(len, paths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(paths)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists], ["doc_id", "row", "key", "size", "sketch", "paths"])
        kept.clear()
        common.release()

    return sign


def _sets(k: int, names: list[str]):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Hashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [shingle_set(words_of(t), kept, k).tobytes() for t in part.column("text").to_pylist()]
                if [hashlib.blake2b(x, digest_size=16).digest() for x in found] != part.column("key").to_pylist():
                    raise RuntimeError("the documents were read in another order than before")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.binary())], [*names, "members"])
        kept.clear()
        common.release()

    return sets


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next paths of sets from the path they are on."""
    for batch in batches:
        ids, paths = [], []
        for i, members, path in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist(), batch.column("path").to_pylist(), strict=True):
            own = np.unique(chosen(np.frombuffer(members, np.uint64), path & 0xFFFFFFFFFFFFFFFF))
            ids += [i] * len(own)
            paths.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int64))], ["id", "path"])


def labelled(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the labels of rows (a) and columns (b) to the smallest that ``hit`` joins them with."""
    while True:
        low_b = np.minimum(b, np.where(hit, a[:, None], np.iinfo(a.dtype).max).min(axis=0)) if len(a) else b
        low_a = np.minimum(a, np.where(hit, low_b[None, :], np.iinfo(a.dtype).max).min(axis=1)) if len(b) else a
        if np.array_equal(low_a, a) and np.array_equal(low_b, b):
            return
        a[:], b[:] = low_a, low_b


def alike(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches and sizes may be links; broadcasts over leading dimensions."""
    both = ((sa == sb) & (sa > 0)).sum(axis=-1)
    some = ((sa > 0) | (sb > 0)).sum(axis=-1)
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (low * UNDER >= high * OVER) & ((both >= AGREE * some) | (low < SMALL))


def compared(marks: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``alike`` for all rows of ``one`` against all of ``two``."""
    hit = np.zeros((len(one), len(two)), bool)
    for a in range(0, len(one), 64):
        p = one[a : a + 64]
        hit[a : a + 64] = alike(marks[p][:, None], size[p][:, None], marks[two][None], size[two][None])
    return hit


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the candidates of each bucket (rows sorted by path, i, j)."""

    def joined(rest: pa.Table) -> pa.RecordBatch:
        path, i, j = (rest.column(c).to_numpy() for c in ("path", "i", "j"))
        size, side = rest.column("size").to_numpy().astype(np.int64), rest.column("side").to_numpy()
        marks = np.frombuffer(b"".join(rest.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(path) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1, [len(path)]])
        long = np.diff(cuts)
        a_rows, b_rows = [], []
        for g in range(2, 9):  # small buckets of a size all at once
            starts = cuts[:-1][(long == g) & (i[cuts[:-1]] == j[cuts[:-1]])]
            for x in range(g):
                for y in range(x + 1, g):
                    for a in range(0, len(starts), 20_000):
                        p, q = starts[a : a + 20_000] + x, starts[a : a + 20_000] + y
                        ok = alike(marks[p], size[p], marks[q], size[q])
                        a_rows.append(p[ok]), b_rows.append(q[ok])
        for s, n in zip(cuts[:-1], long, strict=True):
            if n > 8 or n > 1 and i[s] != j[s]:
                rows = np.arange(s, s + n)
                one = rows[side[rows] == i[s]]
                la = one.copy()
                labelled(compared(marks, size, one, one), la, la)
                if i[s] == j[s]:
                    a_rows.append(one[la != one]), b_rows.append(la[la != one])
                    continue
                # each block alone is joined elsewhere; here a link for each two groups that meet
                two = rows[side[rows] == j[s]]
                lb = two.copy()
                labelled(compared(marks, size, two, two), lb, lb)
                x, y = np.nonzero(compared(marks, size, one, two))
                met = np.unique(np.stack([la[x], lb[y]], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
                a_rows.append(met[:, 0]), b_rows.append(met[:, 1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_rows, b_rows))
        ids = rest.column("id").to_numpy()
        links = np.unique(np.stack([ids[a], ids[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if rest.num_rows < 20_000:
            continue
        path, i, j = (rest.column(c).to_numpy() for c in ("path", "i", "j"))
        other = np.flatnonzero((path != path[-1]) | (i != i[-1]) | (j != j[-1]))
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield joined(rest.slice(0, done).combine_chunks())
            rest = rest.slice(done)
    if rest is not None and rest.num_rows:
        yield joined(rest.combine_chunks())
    rest = None
    common.release()


def _verified(key: tuple, group: pa.Table) -> pa.Table:
    """Exact links of a group of sets: within a block or between two."""
    _, i, j = (x.as_py() for x in key)
    ids, copies, side = group.column("id").to_numpy(), group.column("copies").to_numpy(), group.column("side").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
    n = len(ids)
    size = np.array([len(x) for x in sets], np.int64)
    rows = np.repeat(np.arange(n), size)
    members, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # members of one set alone add nothing to an intersection
    ok = df[column] > 1
    rows, column = rows[ok], (np.cumsum(df > 1) - 1)[column[ok]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    one = np.flatnonzero(side == i)
    two = one if i == j else np.flatnonzero(side == j)
    shared = np.zeros((len(one), len(two)), np.float32)
    for c in range(0, int((df > 1).sum()), COLUMNS):
        x, y = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[rows[x:y], column[x:y] - c] = 1
        shared += part[one] @ part[two].T
    # shared / (a + b - shared) >= OVER / UNDER
    hit = shared.astype(np.int64) * (OVER + UNDER) >= OVER * (size[one][:, None] + size[two][None, :])
    if i == j:
        np.fill_diagonal(hit, False)
    links = np.zeros(n, np.int64)
    links[one] += hit @ copies[two]
    if i != j:
        links[two] += hit.T @ copies[one]
    la, lb = one.copy(), two.copy()
    if i == j:
        lb = la
    labelled(hit, la, lb)
    root = np.arange(n)
    root[one], root[two] = la, lb
    some = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(ids[root[some]])})


def _dealt(df: DataFrame, by: str, keep: list[str]) -> DataFrame:
    """Rows of each value of ``by``, of which there are ``n``, dealt in blocks, with a copy for each other block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    out = df.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(by, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *keep)


def _stepped(rows: DataFrame) -> DataFrame:
    """Sets (id, grp, n, size) of groups with the steps of size that they may have links in, and the blocks of each.

    Groups over ``BLOCK`` are cut by size in steps of ``STEP``: a link's sets are in one step or in two that adjoin, so
    blocks further apart never meet, however long the chain of candidates that holds a group together.
    """
    step = F.when(F.col("n") > BLOCK, F.floor(F.log("size") / math.log(STEP))).otherwise(0).cast("long")
    rows = common.table(rows.withColumn("step", step), "grouped")
    blocks = rows.groupBy("grp", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    near = blocks.select("grp", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.struct(F.col("step").alias("at"), "blocks").alias("b"))
    near = common.table(near.groupBy("grp", "step").agg(F.collect_list("b").alias("near")), "near")
    return rows.join(common.bounded_broadcast(near), ["grp", "step"]).drop("n", "size")


def _crossed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Sets as ``_stepped`` left them, dealt in blocks, with a copy for each other block of the steps beside theirs."""
    block = lambda at, sub: F.shiftleft(at, 32) + sub
    own = F.filter("near", lambda b: b["at"] == F.col("step"))[0]["blocks"]
    others = F.flatten(F.transform("near", lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda sub: block(b["at"], sub))))
    out = rows.withColumn("side", block(F.col("step"), F.pmod(F.xxhash64("id"), own))).withColumn("other", F.explode(others))
    return out.select("grp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *keep)


def _likeness(rows: DataFrame) -> DataFrame:
    """path, likeness: the share of pairs of a bucket's sets that agree in a bin of their sketches, over eight bins."""
    bins = F.explode(F.transform(F.sequence(F.lit(1), F.lit(BINS), F.lit(BINS // 8)), lambda b: F.struct(b.alias("bin"), F.col("sketch").substr(b, F.lit(1)).alias("mark"))))
    counts = rows.select("path", "n", bins.alias("b")).groupBy("path", "n", "b").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("path").agg((F.sum(F.col("c") * F.col("c")) / F.max(F.col("n") * F.col("n") * 8.0)).alias("likeness"))


def candidates(texts: DataFrame, classes: DataFrame, k: int = K, limit: int = LIMIT) -> DataFrame:
    """(a, b): links by which the sets of each bucket that may be similar hang together.

    Only ids and paths are shuffled for all sets; sketches join those that share a path with another.
    """
    frontier = classes.filter("size > 0").select("id", F.explode("paths").alias("path"))
    found = None
    for depth in range(DEPTH + 1):
        counts = frontier.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = common.table(frontier.join(counts, "path").join(classes.select("id", "size", "sketch"), "id"), "shared")
        large = shared.filter(F.col("n") > limit)
        split = None
        if depth < DEPTH and not large.isEmpty():
            split = common.table(_likeness(large).filter(F.col("likeness") < DENSE).select("path"), "split")
            split = None if split.isEmpty() else common.bounded_broadcast(split)
        whole = shared if split is None else shared.join(split, "path", "left_anti")
        rows = _dealt(whole, "path", ["id", "size", "sketch"]).repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
        links = common.table(rows.mapInArrow(_bucketed, "a long, b long"), "candidates")
        found = links if found is None else found.unionByName(links)
        if split is None:
            return found
        members = shared.join(split, "path", "left_semi").select("id", "path")
        sets = class_sets(texts, classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "key"), k)
        frontier = common.table(members.join(sets, "id").mapInArrow(_split, "id long, path long").distinct(), "frontier")
    return found


def class_sets(texts: DataFrame, wanted: DataFrame, k: int = K) -> DataFrame:
    """``wanted`` (id, key and what else goes along) with members; only the texts of those ids are hashed again."""
    wanted = common.bounded_broadcast(common.table(wanted, "wanted"), 500_000)
    texts = texts.select("text", "row").join(wanted, F.col("row") == F.col("id")).drop("row")
    keep = [f for f in wanted.schema.fields if f.name != "key"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "members binary"])
    return texts.mapInArrow(_sets(k, [f.name for f in keep]), schema)


def jaccard_join(docs: DataFrame, k: int = K, runs: int = RUNS, limit: int = LIMIT) -> DataFrame:
    """row, doc_id, class_id, n_links, component_id, kept for each row.

    class_id is the smallest doc_id with the same set; n_links the number of other rows at a similarity of 0.8 or more;
    component_id the smallest doc_id that links reach; ``kept`` marks one row of each component (the first of those
    with that id; null ids come last). ``row`` is a number of each row, the same whenever the same files are read.
    """
    return _joined(*common.row_numbered(docs), k, runs, limit)


def _joined(own: DataFrame, row: str, k: int = K, runs: int = RUNS, limit: int = LIMIT) -> DataFrame:
    texts = texts_of(own, row=row)
    signed = texts.mapInArrow(_signer(k, runs), "doc_id long, row long, key binary, size int, sketch binary, paths array<long>")
    signed = common.table(signed, "signed")
    classes = signed.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
        F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
    )
    classes = common.table(classes.withColumn("id", F.col("least.row")), "classes")
    groups = components(candidates(texts, classes, k, limit)).withColumnRenamed("node", "id").withColumnRenamed("root", "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    wanted = classes.select("id", "key", "copies", "size").join(groups.join(sizes, "grp"), "id")
    dealt = _crossed(class_sets(texts, _stepped(wanted), k), ["id", "copies", "members"])
    found = common.table(dealt.groupBy("grp", "i", "j").applyInArrow(_verified, "id long, links long, root long"), "found")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = common.table(classes.select("id", "least").join(roots.join(counts, "id"), "id"), "linked")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"))
    linked = linked.join(firsts, "root").select("id", "links", "first")
    each = classes.select("key", "id", "copies", "least").join(linked, "id", "left")
    each = each.select("key", F.col("least.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("first"))
    return signed.select("row", "doc_id", "key").join(each, "key").select(
        "row", "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept")
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with its columns."""
    own, row = common.row_numbered(docs)
    dropped = _joined(own, row).filter(~F.col("kept")).select(F.col("row").alias(row))
    dropped = common.bounded_broadcast(common.table(dropped, "dropped"), 500_000)
    return own.join(dropped, row, "left_anti").select(*docs.columns)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
