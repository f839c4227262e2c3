"""License scans by diagonal voting.

Words of whole texts are hashed, and all rolling word k-gram hashes are joined in Spark to the positions of
the same k-grams in license templates. Each hit votes for its diagonal (word in the text less word in the
template); votes are summed by diagonal, and neighbouring diagonals are merged into bands of ``WIDTH``, of which each
half overlaps another, so that a span whose words were shifted by up to half of it lies within one. A band in which enough
template positions have votes is verified: the longest chain of hits that rises in both the text and the template is
aligned, and it must cover enough of the template. A phrase's place is an exact diagonal on
which every k-gram of the phrase has voted. A hit is verified by two independent hashes, 64 and 32 bits.

Grouping is by row, so a passage that many documents share spreads over all tasks; one row's hits are
bounded by its text.

Defined results: null text counts as empty; a null doc_id stays null; repeated rows are scanned each;
overlapping phrases count each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import texts_of

#: Words of a k-gram; diagonals of a band; share of a notice's k-grams that a span must cover in order.
K, WIDTH, COVER = 2, 32, 0.6
#: Words whose hashes a worker keeps, and k-grams in one batch.
CACHE, BATCH = 200_000, 200_000

#: The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of license notices, found with gaps and edits, with their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
)
#: Templates are broadcast; more k-grams than this are refused.
TEMPLATE_GRAMS = 100_000

#: A-Z to a-z, digits, letters and all bytes of non-ASCII characters as they are, anything else to a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


class Hashes(dict):
    """Word to its place in two arrays of hashes, 64 and 32 bits, which hold up to CACHE words and start anew beyond."""

    def __init__(self, room: int = 2 * CACHE) -> None:
        super().__init__()
        self.long, self.short = np.zeros(room, np.uint64), np.zeros(room, np.uint32)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.long):
            self.long, self.short = np.resize(self.long, 2 * at), np.resize(self.short, 2 * at)
        self.long[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.short[at] = zlib.crc32(word)
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.long[at], self.short[at]


def rolled(long: np.ndarray, short: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams from the hashes of words."""
    n = max(0, len(long) - k + 1)
    g, c = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    for i in range(k):
        g = (g ^ long[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        c = c * np.uint32(0x01000193) + short[i : i + n]
    return g.view(np.int64), c.view(np.int32)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """A row for each k-gram position of each template."""
    rows = []
    for t, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        grams, checks = rolled(*Hashes(64).of(words_of(text)), k)
        if not len(grams):
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(int(g), int(c), t, i, len(grams), label, exact) for i, (g, c) in enumerate(zip(grams, checks, strict=True))]
    if len(rows) > TEMPLATE_GRAMS:
        raise ValueError("too many template k-grams to broadcast")
    return spark.createDataFrame(rows, "t_gram long, t_check int, template int, t_at int, n_grams int, label string, exact boolean")


def _grams(k: int):
    names = ["row", "at", "gram", "check"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (row, -1, doc_id, number of words) for each text, then one for each k-gram."""
        kept = Hashes()

        def flush(parts: list[tuple]) -> pa.RecordBatch:
            arrays = [np.concatenate(x) for x in zip(*[p[:4] for p in parts], strict=True)]
            null = np.concatenate([p[4] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[1]), pa.array(arrays[2], mask=null), pa.array(arrays[3])], names)

        for batch in batches:
            parts, size = [], 0
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                grams, checks = rolled(*kept.of(words), k)
                n = len(grams)
                one = (np.array([row]), np.array([-1], np.int32), np.array([doc or 0], np.int64), np.array([len(words)], np.int32), np.array([doc is None]))
                parts.append(one)
                for a in range(0, n, BATCH):
                    m = min(BATCH, n - a)
                    parts.append((np.full(m, row), np.arange(a, a + m, dtype=np.int32), grams[a : a + m], checks[a : a + m], np.zeros(m, bool)))
                    size += m
                    if size >= BATCH:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)

    return emit


def chained(covered) -> int:
    """Hits (diagonal, template position) of the longest chain that rises in the text and in the template."""
    tails: list[int] = []
    for _, t in sorted((d + t, -t) for d, t in covered):
        at = bisect.bisect_left(tails, -t)
        tails[at : at + 1] = [-t]
    return len(tails)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the aligned share of its template in place of a band's hits; of an exact one, the share is given."""
    for batch in batches:
        share = [
            own if hits is None else chained((h["diagonal"], h["t_at"]) for h in hits) / n
            for own, hits, n in zip(batch.column("share").to_pylist(), batch.column("hits").to_pylist(), batch.column("n_grams").to_pylist(), strict=True)
        ]
        keep = [c for c in batch.schema.names if c not in ("hits", "share")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(share, pa.float64())], [*keep, "share"])


def licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    ``score`` is the largest share of a template's k-grams that a span of the row covers (1 with a phrase, 0 without spans).
    """
    spark = docs.sparkSession
    found = F.broadcast(templates(spark, phrases, notices, k))
    grams = texts_of(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_grams(k), "row long, at int, gram long, check int")
    hits = grams.join(found, (F.col("at") >= 0) & (F.col("gram") == F.col("t_gram")) & (F.col("check") == F.col("t_check")), "left")
    hits = hits.filter((F.col("at") < 0) | F.col("template").isNotNull()).select(
        "row", "template", "t_at", "n_grams", "label", "exact", (F.col("at") - F.col("t_at")).alias("diagonal"),
        F.when(F.col("at") < 0, F.col("gram")).alias("doc_id"), F.when(F.col("at") < 0, F.col("check").cast("long")).alias("n_words"),
    )
    tiles = [F.struct(F.floor(x / WIDTH).alias("band"), F.lit(i).alias("side")) for i, x in ((1, F.col("diagonal")), (2, F.col("diagonal") + WIDTH // 2))]
    alone = F.array(F.struct(F.col("diagonal").cast("long").alias("band"), F.lit(0).alias("side")))
    tiled = hits.repartition("row").withColumn("tile", F.explode(F.when(F.coalesce("exact", F.lit(True)), alone).otherwise(F.array(*tiles))))
    votes = tiled.groupBy("row", "template", "n_grams", "label", "exact", "tile").agg(
        F.collect_set(F.struct("diagonal", "t_at")).alias("hits"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words")
    )
    bands = votes.withColumn("share", F.size(F.array_distinct(F.col("hits.t_at"))) / F.col("n_grams"))
    bands = bands.filter(F.col("template").isNull() | F.when(F.col("exact"), F.col("share") == 1.0).otherwise(F.col("share") >= cover))
    bands = bands.select("row", "n_grams", "label", F.coalesce("exact", F.lit(True)).alias("exact"), F.col("tile.band").alias("start"), F.when(~F.col("exact"), F.col("hits")).alias("hits"), "doc_id", "n_words", "share")
    spans = bands.mapInArrow(_aligned, "row long, n_grams int, label string, exact boolean, start long, doc_id long, n_words long, share double")
    base = F.col("exact") & (F.col("share") == 1.0)
    ok = base | (~F.col("exact") & (F.col("share") >= cover))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(ok, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License spans of all documents."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
