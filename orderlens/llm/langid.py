"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies the likelihood of its whole text (hashed byte trigrams), that of
its declared markup language, that of its address suffix, and a prior of its host. The priors are smoothed in
two steps, all rows to domain to host, and the tables of declared languages and suffixes once; all come from
grouped sums of the text posteriors over all rows, each row's own share left out again. An extra class,
``und``, has a uniform text likelihood and takes what none of the languages explains.

The trigram model is fitted on a bounded sample of labelled documents, dealt over all their languages; every other
figure covers all rows.
A hot host is summed before it is shuffled, and the sums are joined back as a broadcast if they were counted
to be few, else by a shuffled join that AQE splits.

Defined results: null, empty or letterless text has only the other evidence; null declared language, suffix or
host is evidence of none; rows are numbered as read, so repeated rows and null ids give a row each; an empty
table gives no rows. A row whose best class is ``und``, or under ``LEAST`` of the posterior, is rejected.
Extra columns of the input are not read; ``accepted_documents`` returns them as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows, with their whole texts, that the trigram model is fitted on, over all languages.
FIT_ROWS = 4000
#: Trigrams beyond which a text's evidence grows with the root of their number, as they repeat, and the weight of one.
FULL, TEMPER = 300, 0.3
#: Rows that a smoothing prior counts as; share of the posterior that a language needs.
KAPPA, LEAST = 20.0, 0.5
#: Log2 of the hashed trigram space; what is added to each count.
BITS, ADD = 16, 0.05
UNKNOWN = "und"

#: What opens a part of a page that isn't text, what closes each kind, and a declared language within an html tag.
OPENS = re.compile(r"(?i)<(?:(script|style)\b|(!--))?")
CLOSES = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), "!--": re.compile("-->"), None: re.compile(">")}
HTML, LANG = re.compile(r"(?i)<html\b"), re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
#: A-Z to a-z; letters and non-ASCII bytes stay; anything else is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def visible(page: str) -> str:
    """A page without its tags, comments, scripts and styles; what is never closed stays, but for its opening ``<``.

    Reads on from the end of each part, and a closing that wasn't found isn't searched for again: linear in the page.
    """
    out, at, none_left = [], 0, set()
    for m in iter(lambda: OPENS.search(page, at), None):
        out.append(page[at : m.start()])
        kind = (m[1] or m[2] or "").lower() or None
        at = m.end()
        for k in dict.fromkeys((kind, None)):  # an unclosed script or comment is still a tag
            end = None if k in none_left else CLOSES[k].search(page, at)
            if end:
                at = end.end()
                out.append(" ")
                break
            none_left.add(k)
    out.append(page[at:])
    return "".join(out)


def declared_language(page: str) -> str | None:
    """The lang attribute of a page's first html tag."""
    m = HTML.search(page)
    found = m and LANG.search(page, m.end(), (page.find(">", m.end()) + 1 or len(page) + 1) - 1)
    return found[1].lower() if found else None


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words of a text, with a space at either end of each word."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of whole texts, and for each text a row of gram -1, so that none lacks its language."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            grams, n = np.unique(trigrams(text.as_py()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(grams) + 1)), pa.array(np.append(grams.astype(np.int32), np.int32(-1))), pa.array(np.append(n, 1))], ["lang", "gram", "n"])


def fitted(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram likelihoods (a row each, then ``und``), from doc_id, text and lang."""
    labelled = labelled.filter("text is not null and lang is not null and lang <> ''").select("doc_id", "lang", "text")
    sample = common.dealt_sample(labelled, "lang", ["doc_id", "text"], FIT_ROWS)
    found = sample.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))  # at most 65,536 rows for each language
    counts = np.zeros((len(names) + 1, 1 << BITS))
    at = {name: i for i, name in enumerate(names)}
    rows = np.fromiter((at[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
    ok = found.column("gram").to_numpy() >= 0
    counts[rows[ok], found.column("gram").to_numpy()[ok]] = found.column("n").to_numpy()[ok]
    p = (counts + ADD) / (counts + ADD).sum(axis=1, keepdims=True)
    p[-1] = 1 / (1 << BITS)
    return [*names, UNKNOWN], np.log(p)


def _scorer(table: np.ndarray, markup: bool):
    table = np.ascontiguousarray(table.T.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, declared = batch.column("text").to_pylist(), batch.column("declared").to_pylist()
            out = []
            for i, text in enumerate(texts):
                text = text or ""
                if markup:
                    declared[i] = declared_language(text) if declared[i] is None else declared[i]
                    text = visible(text)
                grams = trigrams(text)
                total = np.zeros(table.shape[1])
                for a in range(0, len(grams), 1 << 16):
                    total += table[grams[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
                n = len(grams)
                x = total / (1 + n / FULL) ** 0.5 * TEMPER if n else total
                out.append(x - x.max())
            flat = np.concatenate(out) if out else np.zeros(0)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * table.shape[1]), pa.array(flat))
            keep = [c for c in batch.schema.names if c not in ("text", "declared")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(declared, pa.string()), values], [*keep, "declared", "evidence"])
        common.release()

    return score


def _softmax(x: Column) -> Column:
    e = F.transform(F.transform(x, lambda v: v - F.array_max(x)), F.exp)
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Sums of the text posteriors for each value of a column."""
    return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(f"sum_{by}"))


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, markup: bool) -> DataFrame:
    """Adds lang, confidence, text_lang and accepted to ``rows`` of columns row, text, declared, suffix, host, domain.

    The text is dropped; ``markup`` says that it is HTML, whose tags are removed and whose declared language is read.
    """
    n = len(languages)
    keep = [f for f in rows.schema.fields if f.name not in ("text", "declared")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "declared string", "evidence array<double>"])
    scored = rows.mapInArrow(_scorer(table, markup), schema)
    scored = common.table(scored.withColumn("p", _softmax(F.col("evidence"))), "evidence")
    overall = scored.agg(*[F.sum(F.col("p")[i]) for i in range(n)]).first()
    sums = [float(x or 0.0) for x in overall]
    share = [(x + 1.0) / (sum(sums) + n) for x in sums]  # of each language among all rows
    known = F.array(*map(F.lit, share))
    for by in ("declared", "suffix", "domain", "host"):
        found = common.bounded_broadcast(common.table(_sums(scored, by, n), f"by-{by}"))
        scored = scored.join(found, by, "left").withColumn(f"sum_{by}", F.coalesce(F.col(f"sum_{by}"), F.col("p")))

    def others(by: str) -> Column:
        return F.zip_with(f"sum_{by}", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def smoothed(counts: Column, prior: Column) -> Column:
        whole = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, prior, lambda c, q: (c + KAPPA * q) / (whole + KAPPA))

    def likelihood(by: str) -> Column:
        """Log of how much likelier the value is in each language than in all, smoothed to 1."""
        return F.transform(F.zip_with(smoothed(others(by), known), known, lambda c, q: c / q), lambda v: F.log(v))

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(smoothed(others("host"), smoothed(others("domain"), known)), lambda v: F.log(v))
    fused = scored.withColumn("fused", _softmax(plus(plus("evidence", prior), plus(likelihood("declared"), likelihood("suffix")))))
    fused = fused.withColumn("confidence", F.array_max("fused"))
    names = F.array(*map(F.lit, languages))
    best = lambda a, top: F.element_at(names, F.array_position(a, top).cast("int"))
    fused = fused.withColumn("lang", best(F.col("fused"), F.col("confidence"))).withColumn("text_lang", best(F.col("p"), F.array_max("p")))
    fused = fused.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("confidence") >= LEAST))
    return fused.drop("evidence", "p", "fused", *[f"sum_{x}" for x in ("declared", "suffix", "domain", "host")])


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    host = F.when(host != "", host)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"), F.lit(None).cast("string").alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1), F.lit("")).alias("suffix"), host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
    )


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with their columns; the source stands for the host."""
    own, row = common.row_numbered(docs)
    rows = own.select(row, F.col("text").cast("string").alias("text"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.col("source").cast("string").alias("domain"))
    found = identify(rows, *fitted(own.select("doc_id", "text", "lang")), markup=False)
    rejected = common.bounded_broadcast(common.table(found.filter(~F.col("accepted")).select(row), "rejected"))
    return own.join(rejected, row, "left_anti").select(*docs.columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, the trigram model fitted on labelled documents."""
    model = fitted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    found = identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), *model, markup=True)
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "host", "accepted")
