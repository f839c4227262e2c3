"""WARC archives with a two-level capture index.

Captures are sorted by a reversed-host URL key. Each task writes the captures of one key range as an
archive of gzip members (one for each record) and, beside it, the index of that archive as compressed
blocks of index lines, and a directory: a row for each block (first key, last key, place) and the rows' offsets. A table with a
row for each archive says which keys it holds. A look-up bisects the archives, bisects the directory by seeking in
it, reads one index block, bisects its lines, and reads one byte range of the archive. Keys are looked up in batches: sorted
keys are resolved to index blocks, and blocks, not keys, are dealt to tasks, so a key of very many captures is no hot one.

Files get a name of their own in each task attempt; only those that the table of archives, which Spark
commits, names are part of the store. So a lost executor or a speculative attempt leaves files that
nothing refers to, never a broken store.

Defined results: a null ``html`` is the empty payload; a null ``url`` has the empty key and no target
header; rows with a null ``page_id`` are written and read back with null; repeated rows with the smallest
``page_id`` of their payload are all responses (a record can't revisit itself); an empty table gives an
empty store. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads under so many bytes are always written whole.
LEAST_REVISIT_BYTES = 100
#: Index lines in a block, and bytes of an archive that one read may cover.
BLOCK_LINES, READ_BYTES = 1000, 8 << 20
#: Name-space of record ids, so that a rerun writes the same ids.
RECORD_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ARCHIVES = "first_key string, last_key string, archive string, index string, directory string, n_blocks long"
PIECES = "archive string, index string, at long, length long, keys array<string>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.org/x?y`` becomes ``org,b,a)/x?y``; null becomes the empty key."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/:?#]*)", 1))
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/:?#]*(?::\d*)?(.*)$", 1), r"(?s)#.*$", "")
    return F.when(u == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    The representatives of payloads that occur again are aggregated before any shuffle, counted, and
    broadcast if they are few; only beyond that bound does the join shuffle the payloads.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    again = (
        keyed.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).select("page_id", "payload_digest").groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null").drop("n")
    )
    again = common.bounded_broadcast(common.table(again, "payloads"))
    return keyed.join(again, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the response's headers without its payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    own = f"{page_id}|{url}|{digest}|{kind}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(RECORD_IDS, own)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~._-')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record; raises ValueError on a broken one."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response":
        if len(payload) != int(headers["x-payload-length"]) or f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["warc-payload-digest"]:
            raise ValueError("a payload differs from its digest")
    return headers, payload


def _writer(to: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(to)
        name = uuid.uuid4().hex
        archive = index = None
        lines: list[list] = []
        at = index_at = 0
        rows: list[bytes] = []
        first_key = last_key = None

        def flush() -> None:
            nonlocal index_at, first_key, last_key
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            index.write(block)
            rows.append(json.dumps([lines[0][0], lines[-1][0], index_at, len(block)]).encode())
            first_key, last_key = lines[0][0] if first_key is None else first_key, lines[-1][0]
            index_at += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    fs.create_dir(folder, recursive=True)
                    archive, index = fs.open_output_stream(f"{folder}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{folder}/{name}.cdx", compression=None)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], date)
                raw = member.compress(raw) + member.flush()
                archive.write(raw)
                lines.append([row["url_key"], row["page_id"], at, len(raw)])
                at += len(raw)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if archive is not None:
            archive.close()
            index.close()
            with fs.open_output_stream(f"{folder}/{name}.dir", compression=None) as f:
                f.write(b"".join(rows) + np.cumsum([0, *map(len, rows)], dtype="<i8").tobytes() + struct.pack("<q", len(rows)))
            yield pa.RecordBatch.from_pydict({"first_key": [first_key], "last_key": [last_key], "archive": [f"{name}.warc.gz"], "index": [f"{name}.cdx"], "directory": [f"{name}.dir"], "n_blocks": [len(rows)]})

    return write


class Directory(Sequence):
    """The rows (first key, last key, offset and length of the index block) of one archive, each read when it is asked for."""

    def __init__(self, fs, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = struct.unpack("<q", self.file.read_at(8, size - 8))[0]
        self.offsets = np.frombuffer(self.file.read_at(8 * (n + 1), size - 8 * (n + 2)), "<i8")
        self.kept: dict[int, list] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> list:
        if i not in self.kept:
            a, b = int(self.offsets[i]), int(self.offsets[i + 1])
            self.kept[i] = json.loads(self.file.read_at(b - a, a))
        return self.kept[i]

    def blocks_of(self, key: str) -> Iterator[int]:
        """Numbers of the blocks that may hold a key."""
        i = bisect.bisect_left(self, key, key=lambda row: row[1])
        while i < len(self) and self[i][0] <= key:
            yield i
            i += 1


def write_store(pages: DataFrame, to: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives, indexes and directories of ``pages`` under ``to`` and returns the table of archives."""
    spark = pages.sparkSession
    placed = with_revisits(pages).withColumn("url_key", url_key(F.col("url")))
    placed = placed.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    placed.mapInArrow(_writer(f"{to}/files", date), ARCHIVES).write.parquet(f"{to}/archives")
    return spark.read.schema(ARCHIVES).parquet(f"{to}/archives")


def _hits(fs, path: str, at: int, length: int, keys: list[str]) -> list[list]:
    """The lines of some keys (sorted) in one index block."""
    with fs.open_input_file(path) as f:
        lines = [json.loads(x) for x in zlib.decompress(f.read_at(length, at)).decode().split("\n")]
    own, out = [x[0] for x in lines], []
    for key in keys:
        out += lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]
    return out


def _members(fs, path: str, lines: list[list]) -> Iterator[bytes]:
    """The records of index lines in one archive; lines that adjoin are read at once, up to READ_BYTES."""
    with fs.open_input_file(path) as f:
        i = 0
        while i < len(lines):
            j, end = i + 1, lines[i][2] + lines[i][3]
            while j < len(lines) and lines[j][2] == end and end + lines[j][3] - lines[i][2] <= READ_BYTES:
                end += lines[j][3]
                j += 1
            f.seek(lines[i][2])
            raw = f.read(end - lines[i][2])
            for line in lines[i:j]:
                a = line[2] - lines[i][2]
                yield zlib.decompress(raw[a : a + line[3]], 31)
            i = j


def _resolver(to: str, table: str):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index blocks that may hold keys (sorted), each with its keys."""
        import pyarrow.parquet as pq

        fs, folder = common.filesystem(f"{to}/files")
        store, place = common.filesystem(table)
        archives = sorted(pq.read_table(place, filesystem=store).to_pylist(), key=lambda r: (r["last_key"], r["first_key"]))
        lasts = [r["last_key"] for r in archives]
        for batch in batches:
            directories: dict[int, Directory] = {}
            pieces: dict[tuple[int, int], list[str]] = {}
            for key in batch.column("url_key").to_pylist():
                i = bisect.bisect_left(lasts, key)
                while i < len(archives) and archives[i]["first_key"] <= key:
                    if i not in directories:
                        directories[i] = Directory(fs, f"{folder}/{archives[i]['directory']}")
                    for block in directories[i].blocks_of(key):
                        pieces.setdefault((i, block), []).append(key)
                    i += 1
            out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
            for (i, block), keys in pieces.items():
                for k, v in zip(out, (archives[i]["archive"], archives[i]["index"], *directories[i][block][2:], keys), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("archive", pa.string()), ("index", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(pa.string()))]))

    return resolve


def _reader(to: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(f"{to}/files")
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {x.split()[0]: [] for x in RECORDS.split(", ")}
                lines = _hits(fs, f"{folder}/{row['index']}", row["at"], row["length"], row["keys"])
                for raw in _members(fs, f"{folder}/{row['archive']}", lines):
                    h, _ = parse(raw)
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    values = (number("x-page-id"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], number("x-refers-to-page-id"))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                schema = pa.schema([(k, pa.string() if k in ("payload_digest", "record_type") else pa.int64()) for k in out])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return read


def fetch(spark: SparkSession, to: str, urls: DataFrame) -> DataFrame:
    """All captures of the URLs in a column ``url``, each once, by look-ups in the index of the store ``to``."""
    keys = urls.select(url_key(F.col("url")).alias("url_key")).distinct().repartitionByRange("url_key").sortWithinPartitions("url_key")
    pieces = common.table(keys.mapInArrow(_resolver(to, f"{to}/archives"), PIECES), "pieces")
    return pieces.repartition(max(common.tasks(spark), pieces.count() // 16)).mapInArrow(_reader(to), RECORDS)


def lookup(spark: SparkSession, to: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """The captures of one URL with their headers and payloads."""
    key = spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
    archives = spark.read.schema(ARCHIVES).parquet(f"{to}/archives").filter((F.col("first_key") <= key) & (F.col("last_key") >= key))
    fs, folder = common.filesystem(f"{to}/files")
    found = []
    for row in archives.orderBy("first_key", "last_key").toLocalIterator():
        directory = Directory(fs, f"{folder}/{row['directory']}")
        for i in directory.blocks_of(key):
            hits = _hits(fs, f"{folder}/{row['index']}", *directory[i][2:], [key])
            found += [parse(raw) for raw in _members(fs, f"{folder}/{row['archive']}", hits)]
    return found


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as a store in the shared folder, and the captures of all their URLs looked up in it."""
    to, pages = common.fresh_path(spark, "warc"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_store(pages, to)
    return fetch(spark, to, pages)


ORACLE = {
    "op9_warc": r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
r as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when r.first_id is null or r.first_id = p.page_id then 'response' else 'revisit' end as record_type,
  case when r.first_id is null or r.first_id = p.page_id then null else r.first_id end as refers_to
from p left join r on p.payload_digest = r.payload_digest and p.payload_bytes >= 100
"""
}
