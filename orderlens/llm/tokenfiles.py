"""Token-id files: adaptive context-mixing range-coded blocks in document order.

A file holds a run of documents in ascending doc_id order, as frames of one block each:

    "TIDB" | length of the document table | length of the code | table | code

(lengths as big-endian 32-bit numbers). The table is the zlib-compressed list of the block's documents: little-endian
triples of 64-bit numbers (doc_id, ids in this block, flags: 1 continued from the block before, 2 null doc_id).
The code is a block as ``coder`` writes it, with a checksum of its own; every block is read independently.

Texts are range-partitioned by id, and by a hash of the text so that a repeated id is no hot key; they are encoded
after that shuffle, once, and each task writes one file under a name of its own. Only files that the manifest names, which
Spark commits, are part of the store. Files are read as a stream of frames.

Defined results: null text has no ids but the end id; null doc_ids come first; repeated doc_ids are documents
each, ordered by the hash of their texts; an empty table gives an empty store. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder, common
from .tokens import TOGETHER, encoder, texts_of, vocabulary

#: Ids of a block; the id that ends a document in op6.
BLOCK, END = 1 << 17, 2
MAGIC = b"TIDB"
MANIFEST = "part int, file string, n_docs long, n_ids long, n_blocks long"


def portions(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about ``most`` bytes of texts at a time: the ids of these are what a worker holds."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // most
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size)) + 1):
        if len(rows):
            yield batch.slice(rows[0], len(rows))


def _blocks(path: str, end: int, width: int, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(table, raw) for each block of the partition's documents."""
        encode, head = encoder(path), bytes([width, bits])
        table: list[tuple[int, int, int]] = []
        raw: list[bytes] = []
        have = 0

        def block() -> pa.RecordBatch:
            nonlocal have
            packed = zlib.compress(np.array(table, "<i8").tobytes(), 1)
            out = pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([head + b"".join(raw)], pa.binary())], ["docs", "raw"])
            table.clear(), raw.clear()
            have = 0
            return out

        for batch in (part for whole in batches for part in portions(whole)):
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, encode(batch.column("text")), strict=True):
                left, flags = np.append(ids, np.uint32(end)).astype(f"<u{width}").tobytes(), 2 if doc is None else 0
                while True:
                    room = (size - have) * width
                    part, left = left[:room], left[room:]
                    table.append((doc or 0, len(part) // width, flags))
                    raw.append(part)
                    have += len(part) // width
                    if have == size:
                        yield block()
                    if not left:
                        break
                    flags |= 1
            del ids
            common.release()
        common.release()
        if table:
            yield block()

    return run


def _written(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = common.filesystem(to)
        part, name, out = TaskContext.get().partitionId(), None, None
        docs = ids = blocks = 0
        for batch in batches:
            for table, code in zip(batch.column("docs"), batch.column("code"), strict=True):
                table, code = table.as_py(), code.as_py()
                if out is None:
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.tid"
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(MAGIC + struct.pack(">II", len(table), len(code)) + table + code)
                own = np.frombuffer(zlib.decompress(table), "<i8").reshape(-1, 3)
                docs, ids, blocks = docs + int((own[:, 2] & 1 == 0).sum()), ids + int(own[:, 1].sum()), blocks + 1
        common.release()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [docs], "n_ids": [ids], "n_blocks": [blocks]})

    return run


def write_ids(docs: DataFrame, path: str, to: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Writes the ids of whole texts, each with the end id, and returns the manifest (a row a file)."""
    spark = docs.sparkSession
    coder.register(spark)
    n = max(_size_of(path), end + 1)
    bits = max(4, (n - 1).bit_length() + (-(n - 1).bit_length()) % 4)
    width = 2 if bits <= 16 else 4
    place = ["doc_id", F.xxhash64("text")]
    placed = texts_of(docs).repartitionByRange(*place).sortWithinPartitions(*place)
    coded = placed.mapInArrow(_blocks(path, end, width, bits, block), "docs binary, raw binary").select("docs", F.call_function(coder.ENCODE, "raw").alias("code"))
    coded.mapInArrow(_written(f"{to}/files"), MANIFEST).write.parquet(f"{to}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{to}/manifest")


def _size_of(path: str) -> int:
    lib = encoder(path).lib
    return lib.get_vocab_size() if path.endswith(".json") else lib.get_piece_size()


def _frames(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(f"{to}/files")
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{folder}/{row['file']}", compression=None) as f:
                    first = True
                    while head := f.read(12):
                        if head[:4] != MAGIC:
                            raise ValueError(f"{row['file']}: a frame is broken")
                        n, m = struct.unpack(">II", head[4:])
                        table, code = f.read(n), f.read(m)
                        yield pa.RecordBatch.from_arrays([pa.array([row["start"] if first else None], pa.int64()), pa.array([zlib.decompress(table)], pa.binary()), pa.array([code], pa.binary())], ["start", "docs", "code"])
                        first = False

    return run


def _documents(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document of a stream of blocks; ``start`` marks the first block of a file."""
        at, open_ = 0, None
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        kinds = [pa.int64()] * 4
        for batch in batches:
            done: list[list] = []
            for start, table, raw in zip(batch.column("start").to_pylist(), batch.column("docs"), batch.column("raw"), strict=True):
                if start is not None:
                    if open_:
                        done.append(open_)
                    at, open_ = start, None
                raw, place = memoryview(raw.as_buffer()), 0
                for doc, n, flags in np.frombuffer(table.as_buffer(), "<i8").reshape(-1, 3).tolist():
                    own = np.frombuffer(raw[place : place + n * width], f"<u{width}").astype("<u4").tobytes()
                    place += n * width
                    if flags & 1:
                        open_[2] += n
                        open_[3] = zlib.crc32(own, open_[3])
                    else:
                        if open_:
                            done.append(open_)
                        open_ = [None if flags & 2 else doc, at, n, zlib.crc32(own)]
                    at += n
            raw = table = None
            common.release()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(open_, kinds, strict=True)], names)

    return run


def read_ids(spark: SparkSession, to: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; blocks are checked against their checksums."""
    coder.register(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{to}/manifest")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("start"))
    frames = files.repartition(4 * common.tasks(spark)).mapInArrow(_frames(to), "start long, docs binary, code binary")
    raw = frames.select("start", "docs", F.call_function(coder.DECODE, "code").alias("raw"))
    return raw.mapInArrow(_documents(width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents written to files in the shared folder and read back."""
    to = common.fresh_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), to)
    return read_ids(spark, to)
