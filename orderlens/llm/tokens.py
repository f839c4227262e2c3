"""Token ids and counts of whole texts with public tokenizers, huge texts by overlapping chunks.

A text over ``CHUNK`` characters is encoded in chunks that overlap, with offsets. Two neighbours are
spliced at a boundary that is proven stable: a lone space between two non-space characters, which no
tokenizer of the supported kinds joins to what stands before it, at which both encodings have a token
boundary, and around which both have the same tokens at the same offsets. If the overlap holds no such
boundary it is doubled, at last to the whole text. So memory is bounded by the chunk, not the text.

Tokenizers that drop white space can't join across it. For these the white-space separated words of a batch are
split and numbered by Arrow, each distinct word is looked up in a bounded table of ids, the library is asked for those that the
table lacks, and the ids of all texts are gathered by numpy. On one thread and 33 MB of documents this takes 9 s of
CPU, where the library with whole texts takes 45 s and a dictionary look-up for each word 29 s.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters in a chunk, and in the overlap to begin with; tokens that must agree on both sides.
CHUNK, OVERLAP, AGREE = 1 << 15, 256, 2
#: Characters of words kept in a worker's table (it starts anew beyond), and of texts that are split together.
TABLE, TOGETHER = 8_000_000, 8_000_000
#: Words whose ids are gathered at a time.
GATHERED = 1 << 15
#: Tokens above which op8 flags a document.
LIMIT = 2048

#: Fixed value: the pre-tokenizer pattern under which a run of letters is a word by itself, and a mark after it too.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that normalizing only lowers, and marks of which a run after letters is a word by itself.
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")
MARKS = ".,;:!?#$%&*"
LOWER = "^[a-zß-öø-ÿ]+$"

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - ends + size, size)


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows ``at``, one row's after the other's, and how many each has; some rows at a time, for memory."""
    size = size[at]
    cuts = np.arange(0, len(at) + GATHERED, GATHERED)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(size, cuts[:-1]))]) if len(at) else np.zeros(1, np.int64)
    out = np.empty(int(ends[-1]), values.dtype)
    for a, b, i in zip(cuts, cuts[1:], range(len(ends) - 1), strict=False):
        np.take(values, ranges(start[at[a:b]], size[a:b]), out=out[ends[i] : ends[i + 1]], mode="clip")
    return out, size


class Words:
    """Words and their ids: a place for each word, and of each place where its ids start and how many there are."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = self.chars = 0

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Takes new words with their ids, one word's after the other's."""
        n, new = len(self.at), len(words)
        while n + new > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[n : n + new] = sizes
        self.start[n : n + new] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.at.update(zip(words, range(n, n + new), strict=True))
        self.used += len(ids)
        self.chars += sum(map(len, words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, and how many each has."""
        return gathered(self.ids, self.start, self.size, places)


class Encoder:
    """One tokenizer: .json by the tokenizers library, .model by sentencepiece."""

    def __init__(self, path: str) -> None:
        self.path, self.json = path, path.endswith(".json")
        if self.json:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            spec = json.loads(self.lib.to_str())
            self.apart = self._drops_space(spec)
            self.bare = self._bare(spec) if self.apart else None
        else:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.apart, self.bare = False, None
        self.words = Words()

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Whether pre-tokens are the matches of a pattern that can't match white space, and no added token holds any."""
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            return False
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
            return False
        pattern = re.sub(r"\[\^\\s[^\]]*\]", "", first["pattern"].get("Regex", " "))
        return not re.search(r"\\[sSWDPXRO]|\[\^|\.|\s", pattern)

    def _bare(self, spec: dict):
        """The same library's model without the normalizer, for words of plain letters that are in lower case already."""
        from tokenizers import Tokenizer

        model, steps, cuts = spec["model"], [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])], spec["pre_tokenizer"]["pretokenizers"]
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        if steps != ["NFC", "Replace", "Lowercase"] or cuts[0]["pattern"].get("Regex") != LETTER_RUNS or cuts[1:] != [level] or model["type"] != "BPE" or model["dropout"] or not model["end_of_word_suffix"]:
            return None
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        self.ends[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"])]] = True
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}))

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the table, which learns those that it lacks."""
        at = np.fromiter(map(self.words.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [words[i] for i in new]
            plain = np.asarray(pc.match_substring_regex(pa.array(missing, pa.string()), LOWER)) & (self.bare is not None)
            n = len(self.words.at)
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            self._learn_bare([missing[i] for i in order[: plain.sum()]])
            self._learn_by_library([missing[i] for i in order[plain.sum() :]])
            at[new[order]] = np.arange(n, n + len(new))
        return at

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: ids one after the other, where each word's start and how many they are."""
        if self.words.chars > TABLE:
            self.words.clear()
        if self.bare is None:
            ids, size = self.words.of(self._places(words.to_pylist()))
        else:
            core, marks = pc.ascii_rtrim(words, MARKS), pc.utf8_ltrim(words, LETTERS)
            cut = pc.equal(pc.add(pc.binary_length(core), pc.binary_length(marks)), pc.binary_length(words))
            core, marks = pc.if_else(cut, pc.utf8_lower(core), words).dictionary_encode(), pc.if_else(cut, marks, "").dictionary_encode()
            both = [x.indices.to_numpy() for x in (core, marks)]
            core_at, marks_at = self._places(core.dictionary.to_pylist()), self._places(marks.dictionary.to_pylist())
            ids, size = self.words.of(np.stack([core_at[both[0]], marks_at[both[1]]], axis=1).ravel())
            size = size.reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(size) - size, size

    def _learn_bare(self, words: list[str]) -> None:
        """Learns words of letters in lower case: one call for many, their last ids tell them apart."""
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) != len(part) or to[-1] != len(ids):
                raise RuntimeError("a word has no end")
            self.words.add(part, np.diff(to, prepend=0), ids)

    def _learn_by_library(self, words: list[str]) -> None:
        """Learns any words: one call for many, offsets say whose the ids are."""
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids, starts, _ = self.library_spans(" ".join(part))
            to = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in part]))
            self.words.add(part, np.diff(to, prepend=0), ids)

    def spans(self, text: str) -> Spans:
        """Ids, starts and ends (characters of ``text``) of its tokens; those of a word in the table all span the word."""
        if not self.apart:
            return self.library_spans(text)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = pa.array(words, pa.string()).dictionary_encode()
        ids, n = gathered(*self._table(found.dictionary), found.indices.to_numpy())
        long = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(long + 1) - long - 1
        return ids, np.repeat(starts, n), np.repeat(starts + long, n)

    def library_spans(self, text: str) -> Spans:
        """The same with the library's own offsets."""
        if self.json:
            e = self.lib.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            return np.array(e.ids, dtype=np.uint32), at[:, 0], at[:, 1]
        pieces = self.lib.encode(text, return_type="proto").pieces
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before a byte
        ids = np.fromiter((p.id for p in pieces), np.uint32, len(pieces))
        return ids, chars[np.fromiter((p.begin for p in pieces), np.int64, len(pieces))], chars[np.fromiter((p.end for p in pieces), np.int64, len(pieces))]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by the library, each text whole."""
        if not texts:
            return []
        found = (e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)) if self.json else self.lib.encode(texts, num_threads=1)
        return [np.array(x, dtype=np.uint32) for x in found]

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of some texts by their words."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, n = gathered(*self._table(words.dictionary), words.indices.to_numpy())
        starts = split.offsets.to_numpy().astype(np.int64)
        return np.split(ids, np.concatenate([[0], np.cumsum(n)])[starts[1:-1] - starts[0]])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, none of them null; about ``TOGETHER`` bytes of short ones are taken together."""
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(size)
        short = np.flatnonzero(size <= CHUNK)
        for rows in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // TOGETHER)) + 1):
            part = texts.take(pa.array(rows))
            for i, ids in zip(rows.tolist(), self._together(part) if self.apart else self.plain(part.to_pylist()), strict=True):
                out[i] = ids
        for i in np.flatnonzero(size > CHUNK).tolist():
            out[i] = spliced(self.spans, texts[i].as_py())
        return out


def cut(text: str, a: Spans, b: Spans, lo: int, hi: int) -> int | None:
    """A stable boundary in text[lo:hi], which both ``a`` (left) and ``b`` (right; absolute offsets) cover, or None."""
    middle = (lo + hi) // 2
    spots = [p for p in range(lo + 1, hi - 1) if text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()]
    for p in sorted(spots, key=lambda p: abs(p - middle)):
        same = True
        i, j = int(np.searchsorted(a[1], p)), int(np.searchsorted(b[1], p))
        # what a byte-level token of several bytes or an empty prefix piece spans may not reach over p
        if (i and a[2][:i].max(initial=0) > p) or (j and b[2][:j].max(initial=0) > p):
            continue
        left = min(AGREE, i, j)
        right = min(AGREE, len(a[0]) - i, len(b[0]) - j)
        if left < 1 or right < 1:
            continue
        for x, y in zip(a, b, strict=True):
            same &= bool(np.array_equal(x[i - left : i], y[j - left : j]) and np.array_equal(x[i : i + right], y[j : j + right]))
        if same and a[2][i + right - 1] < hi and b[1][j - left] > lo:
            return p
    return None


def spliced(spans: Callable[[str], Spans], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of ``text`` from overlapping chunks of about ``chunk`` characters; the same as of the whole text."""
    n, begin, end = len(text), 0, min(chunk, len(text))
    here, done, out = spans(text[:end]), 0, []
    while end < n:
        width, found = overlap, None
        while found is None:
            lo = max(end - width, done)
            to = min(n, lo + max(chunk, 2 * width))
            ids, starts, ends = spans(text[lo:to])
            after = (ids, starts + lo, ends + lo)
            found = cut(text, here, after, lo, end)
            if found is None and lo <= done:  # the whole chunk holds no stable boundary: read on from where it began
                after = None
                break
            width *= 2
        if after is None:
            end = min(n, end + (end - begin))
            ids, starts, ends = spans(text[begin:end])
            here = (ids, starts + begin, ends + begin)
            continue
        inside = (here[1] >= done) & (here[1] < found) if done else here[1] < found
        out.append(here[0][inside])
        here, begin, done, end = after, lo, found, to
    out.append(here[0][here[1] >= done] if done else here[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are, and ``row`` as row where one is named."""
    more = [] if row is None else [F.col(row).alias("row")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null text counts as empty, a null doc_id stays null.

    Row by row and without a shuffle; repeated rows are counted each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            n = [len(x) for x in encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts_of(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the word-level BPE."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
