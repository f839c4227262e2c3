"""Sampled segmentations over a SentencePiece lattice, and lossless decoding.

Forward filtering sums the weights of all segmentations that end at each character; backward sampling then
draws the last piece, the piece before it, and so on. No piece goes over the start of a space run, so the
lattice of a text falls apart into units (a space run and what follows to the next). The distinct units of a
bounded batch are filtered together, those of a length at once, into one table of edges, and all units of the
batch are sampled at once, a piece of each in a step. The random number for a step is a hash of seed, row key and the place in the text:
the same row gets the same segmentation in any batch, partition or attempt.

A character without a piece becomes its byte pieces, and so does the mark that pieces use for a space.
Decoding joins the bytes of the pieces and drops the space that encoding put first, so it gives the text.

Defined results: null text is the empty text, which has no pieces; a null key is 0; repeated rows get the
same pieces; an empty table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import texts_of, vocabulary

#: Exponent of piece weights (0: all segmentations alike; large: the best one), and the seed.
ALPHA, SEED = 1.0, 7
#: Log weight of a character's byte pieces; characters and rows of a batch; the longest unit that is filtered with
#: others, and how many at a time: these bound a worker's memory.
BYTES_WEIGHT, BATCH, ROWS, TOGETHER, UNITS = -14.0, 1 << 20, 300, 32, 5000
MARK = "▁"
#: Odd multiplier of the rolling hash by which substrings are looked up among pieces.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Places of known hashes, by buckets: a bucket's are neighbours, so that finding one takes as many looks as the fullest bucket holds."""

    def __init__(self, known: np.ndarray) -> None:
        bits = max(8, (16 * len(known)).bit_length())
        self.shift, best = np.uint64(64 - bits), None
        for i in range(1, 65):  # multipliers, until no bucket holds more than two
            times = mixed64(np.full(1, i, np.uint64))[0] | np.uint64(1)
            bucket = (known * times >> self.shift).view(np.int64)
            most = int(np.bincount(bucket).max(initial=1))
            if best is None or most < best:
                best, self.times, own = most, times, bucket
            if most <= 2:
                break
        self.order, self.depth = np.argsort(own, kind="stable"), best
        self.start = np.searchsorted(own[self.order], np.arange(1 << bits)).astype(np.int32)
        self.known = np.append(known[self.order], np.full(best, 2**64 - 1, np.uint64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``known`` (any, where a hash isn't known), and which are known."""
        first = np.take(self.start, (h * self.times >> self.shift).view(np.int64))
        at, hit = first, np.take(self.known, first) == h
        for j in range(1, self.depth):
            same = np.take(self.known, first + j) == h
            at, hit = at + j * same, hit | same
        return at, hit


class Lattice:
    """Pieces with weights, and the filtered lattices of units."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        scores = np.array([lib.get_score(i) for i in plain])
        # merge-based models score a piece by less its rank; by Zipf's law that is a frequency
        if np.array_equal(scores, np.round(scores)):
            scores = -np.log(1.0 - scores + scores.max() + 2.0)
        self.piece = {lib.id_to_piece(i).replace(MARK, " "): (i, float(np.exp(alpha * s))) for i, s in zip(plain, scores, strict=True)}
        self.spelt = float(np.exp(alpha * BYTES_WEIGHT))
        self.most = max(map(len, self.piece))
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces, so some texts have no lossless encoding")
        self.raw: list[bytes] = [b""] * n
        for text, (i, _) in self.piece.items():
            self.raw[i] = text.encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.n = n
        # units end before a space, and at line ends too if no piece holds one beside other characters
        self.unit_of = re.compile("\n| *[^ \n]+| +" if not any("\n" in x and len(x) > 1 for x in self.piece) else " +[^ ]*")
        self.hashes: list[tuple] = [()]  # by length: hashes, ids, weights
        for size in range(1, self.most + 1):
            own = [(x, *v) for x, v in self.piece.items() if len(x) == size]
            h = np.zeros(len(own), np.uint64)
            for c in np.array([[ord(c) for c in x[0]] for x in own], np.uint64).reshape(-1, size).T:
                h = h * BASE + c + np.uint64(1)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have the same hash")
            table = Hashes(h)
            ids, weights = np.array([x[1] for x in own], np.int32)[table.order], np.array([x[2] for x in own], np.float64)[table.order]
            self.hashes.append((table, np.append(ids, np.full(table.depth, -1, np.int32)), np.append(weights, np.zeros(table.depth))))

    def forget(self) -> None:
        """Begins the table of a batch."""
        self.unit: dict[str, int] = {}  # its last state; its first is that less its length
        self.spelled: list[tuple[int, ...]] = []  # byte pieces of characters, by id less n
        self.spelling: dict[str, int] = {}
        self.states = 0
        self.table: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cumulated share in a state, step back, id

    def spell(self, char: str) -> int:
        """The stand-in id of a character's byte pieces."""
        at = self.spelling.get(char)
        if at is None:
            at = self.spelling[char] = len(self.spelled)
            self.spelled.append(tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass")))
        return self.n + at

    def learn_all(self, units: list[str], n: int) -> None:
        """Filters the lattices of units of one length."""
        most, base = min(self.most, n), self.states
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        weight = np.zeros((len(units), n + 1, most + 1))
        ids = np.zeros((len(units), n + 1, most + 1), np.int32)
        h = np.zeros((len(units), n + 1), np.uint64)
        for size in range(1, most + 1):
            h = h[:, : n - size + 1] * BASE + codes[:, size - 1 :] + np.uint64(1)
            known, own, w = self.hashes[size]
            k, hit = known.find(h)
            weight[:, size:, size] = np.where(hit, w[k], 0.0)
            ids[:, size:, size] = own[k]
        for u, i in zip(*np.nonzero(weight[:, 1:, 1] == 0), strict=True):
            if units[u][i] not in self.piece:
                weight[u, i + 1, 1], ids[u, i + 1, 1] = self.spelt, self.spell(units[u][i])
        total = np.zeros((len(units), n + 1))
        total[:, 0] = 1.0
        for i in range(1, n + 1):
            m = min(i, most)
            run = np.cumsum(total[:, i - m : i][:, ::-1] * weight[:, i, 1 : m + 1], axis=1)
            total[:, i] = run[:, -1]
            run /= run[:, -1:]
            run += base + i + (n + 1) * np.arange(len(units))[:, None]
            keep = weight[:, i, 1 : m + 1] > 0
            weight[:, i, 1 : m + 1] = np.where(keep, run, 0.0)
        u, i, back = np.nonzero(weight)
        cum = weight[u, i, back]
        self.table.append((cum, back.astype(np.int32), ids[u, i, back]))
        self.unit.update(zip(units, range(base + n, base + (n + 1) * len(units), n + 1), strict=True))
        self.states += (n + 1) * len(units)

    def learn(self, unit: str) -> None:
        """The same for one unit of any length."""
        n, base, most, get = len(unit), self.states, self.most, self.piece.get
        total = [1.0]  # summed weights up to each character
        cum, back, ids = [], [], []
        for i in range(1, n + 1):
            run, parts = 0.0, []
            for j in range(i - most if i > most else 0, i):
                hit = get(unit[j:i])
                if hit is not None:
                    run += total[j] * hit[1]
                    parts.append(run)
                    back.append(i - j)
                    ids.append(hit[0])
            if unit[i - 1] not in self.piece:
                run += total[i - 1] * self.spelt
                parts.append(run)
                back.append(1)
                ids.append(self.spell(unit[i - 1]))
            total.append(run)
            state = base + i
            cum += [state + p / run for p in parts]
            if run < 1e-200:  # long units: what is yet needed is scaled up
                total[-most:] = [x * 1e200 for x in total[-most:]]
        self.table.append((np.array(cum), np.array(back, np.int32), np.array(ids, np.int32)))
        self.unit[unit] = base + n
        self.states += n + 1

    def sample(self, keys: list[int], texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each text has."""
        self.forget()
        units: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            if text:
                own = self.unit_of.findall(f" {text}")
                per_text[t] = len(own)
                units += own
        by_size: dict[int, list[str]] = {}
        for u in dict.fromkeys(units):
            by_size.setdefault(len(u), []).append(u)
        for size, own in sorted(by_size.items()):
            if size <= TOGETHER:
                for a in range(0, len(own), UNITS):
                    self.learn_all(own[a : a + UNITS], size)
            else:
                for u in own:
                    self.learn(u)
        cum, backs, edge_ids = (np.concatenate(x) for x in zip(*self.table, strict=True)) if self.table else (np.zeros(0),) * 3
        known = self.unit
        n_units = len(units)
        state = np.fromiter(map(known.__getitem__, units), np.int64, n_units)
        size = np.fromiter(map(len, units), np.int64, n_units)
        owner = np.repeat(np.arange(len(texts)), per_text)
        ends = np.cumsum(size)
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])[:-1]] if n_units else np.zeros(len(texts), np.int64)
        place = (ends - before[owner]).astype(np.uint64)
        salt = mixed64(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[owner]
        left, live = size.copy(), np.arange(n_units)
        steps, count = [], np.zeros(n_units, np.int64)
        while len(live):
            u = (mixed64(salt[live] + place[live] * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(24)).astype(np.float64) * 2.0**-40
            k = np.searchsorted(cum, state[live] + u, side="right")
            step = backs[k]
            steps.append((live, edge_ids[k]))
            count[live] += 1
            state[live] -= step
            left[live] -= step
            place[live] -= step.astype(np.uint64)
            live = live[left[live] > 0]
        out = np.zeros(int(count.sum()), np.int32)
        last = np.cumsum(count) - 1
        for s, (at, ids) in enumerate(steps):
            out[last[at] - s] = ids
        n_ids = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        if self.spelled and (odd := np.flatnonzero(out >= self.n)).size:
            long = np.ones(len(out), np.int64)
            sizes = np.array([len(x) for x in self.spelled])
            long[odd] = sizes[out[odd] - self.n]
            whose = np.repeat(np.arange(len(texts)), n_ids)
            n_ids = np.bincount(whose, weights=long, minlength=len(texts)).astype(np.int64)
            starts = np.cumsum(long) - long
            wide = np.repeat(out, long)
            for b in range(int(sizes.max())):
                has = odd[long[odd] > b]
                wide[starts[has] + b] = [self.spelled[x][b] for x in (out[has] - self.n).tolist()]
            out = wide
        return out, n_ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    """The worker's lattice of a model file."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def sampled(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids and lossless (whether decoding them gave the text) for each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, alpha)
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                b, chars = a, 0
                while b < batch.num_rows and b < a + ROWS and (b == a or chars + len(batch.column("text")[b].as_py()) <= BATCH):
                    chars += len(batch.column("text")[b].as_py())
                    b += 1
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                ids, n = model.sample([k or 0 for k in part.column("doc_id").to_pylist()], texts, seed)
                cuts = np.concatenate([[0], np.cumsum(n)])
                same = [model.decode(ids[i:j]) == t for i, j, t in zip(cuts, cuts[1:], texts, strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), lists, pa.array(same)], ["doc_id", "n_pieces", "ids", "lossless"])
                a = b
            model.forget()
            common.release()

    return texts_of(docs).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))
