"""Benchmark passages in documents, by latent semantic retrieval.

Words are compared in lower case and without ASCII punctuation. Benchmark items
are cut into pieces of at most ``PIECE`` words, documents into passages of
``2 * HALF`` words that overlap by half.

1. Texts are read once, whatever the number of items: of each document the
   places and numbers of the words that occur in the benchmark are stored, and
   the further passes read those. Document frequencies over all half passages
   give TF-IDF weights; a word in more than one of ``common_in`` of them weighs
   nothing.
2. A randomised SVD of the TF-IDF matrix ``A`` of all half passages, over all
   words of the items at hand, with the items' own rows stacked below at equal
   total energy. Tasks send their part of ``Y = A^T (A R)`` for a random ``R``,
   summed by word in the cluster; ``Y`` and ``R`` give the leading right
   singular vectors in one pass (Nystroem's approximation of ``A^T A``). What is
   sent depends on the vocabulary and the rank, not on the documents.
3. Every passage is compared with every piece by the cosine of their latent
   vectors; those of ``near`` or more are candidates. A basis of fixed rank
   cannot hold every direction of a large benchmark, so an exact way finds the
   rest: an index from the ``keys`` rarest words of each piece also proposes
   each passage that holds, with its surroundings, as many of them as a copy
   must have at least. So no copy is lost, however many items there are.
4. A candidate is confirmed by longest common subsequences of the piece and the
   passage with its surroundings. A copy has ``copy`` of the piece's words and
   of its key words in order; or ``loose`` of both, if the answer, the last
   third of the key words, is there in order for ``answer`` of them. A
   paraphrase, which only the latent search proposes, has ``paraphrase`` of the
   words, a third of the key words and the answer; pieces of fewer than twice
   ``keys`` words, whose key words are not rare, have none. A piece of fewer
   than ``short`` words must be there word by word.

``Limits`` holds these numbers. Pieces below ``least_words`` are not searched:
a phrase of three words or fewer is in any large corpus by chance. With 1 they
are, word by word like other short ones.

The benchmark is the query set. Items are searched in blocks of ``BLOCK_ITEMS``,
two passes over the stored words each; where the vocabulary passes
``VOCABULARY`` words, the items after that are another benchmark, with another
pass over the texts.

Defined results: null and empty texts and items match nothing. Rows are told
apart by id and text; rows with a null id are reported with a null id. Equal
items each match. Repeated rows give one match. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, chunks, materialize, read_table

PIECE = 48
HALF = 32
BLOCK_ITEMS = 4096
VOCABULARY = 1 << 21
RANK = 64
OVERSAMPLE = 8
#: Counts of shared key words that are held or added up at once.
SHARED = 1 << 22


@dataclass(frozen=True)
class Limits:
    """When a passage is a candidate for a piece, and when it is confirmed."""

    keys: int = 12
    common_in: float = 16.0
    near: float = 0.4
    copy: float = 0.6
    loose: float = 0.5
    paraphrase: float = 0.4
    answer: float = 0.75
    short: int = 8
    least_words: int = 4


LIMITS = Limits()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Piece:
    """A piece's words as numbers in the vocabulary; its key words in order."""

    def __init__(self, words: list[int], keys: list[int], limits: Limits = LIMITS):
        self.words, self.limits = words, limits
        answer = keys[-max(1, len(keys) // 3) :]
        self.parts = [(len(w), _masks(w)) for w in (words, keys, answer)]

    def _phrase(self, words: list[int], places: list[int]) -> bool:
        n = len(self.words)
        return any(words[i : i + n] == self.words and places[i + n - 1] - places[i] == n - 1 for i in range(len(words) - n + 1))

    def matches(self, words: list[int], places: list[int], near: float = 1.0) -> tuple[float, bool]:
        """The part of the piece's words that a region has in order, and whether
        that makes it a copy or, with a cosine of ``near``, a paraphrase."""
        at = self.limits
        if len(self.words) < at.short:
            return 1.0, self._phrase(words, places)
        n, masks = self.parts[0]
        share = common_subsequence(words, masks, n) / n
        if share < min(at.loose, at.paraphrase):
            return share, False
        keys, answer = (common_subsequence(words, m, n) / n for n, m in self.parts[1:])
        copy = share >= at.copy and keys >= at.copy
        loose = share >= at.loose and keys >= at.loose and answer >= at.answer
        para = near >= at.near and n >= 2 * at.keys and share >= at.paraphrase and 3 * keys >= 1 and answer >= at.answer
        return share, copy or loose or para


def common_subsequence(words: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, bit-parallel over the piece."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for c in chunks(pa.array(texts, pa.string()), table=PLAIN):
        out += [c.hashes[c.first[r] : c.first[r + 1]] for r in range(len(c.rows))]
    return out


class Vocabulary:
    """Numbers of known words, by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.sieve = np.zeros(1 << 18, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words, and their numbers."""
        at = np.flatnonzero(self.sieve[(hashes >> np.uint64(46)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return at[:0], at[:0]
        f = np.searchsorted(self.hashes, hashes[at])
        f[f == len(self.hashes)] = 0
        ok = self.hashes[f] == hashes[at]
        return at[ok], f[ok]


class Queries:
    """A block of benchmark items as flat arrays, small enough to broadcast.

    Piece ``i`` is of item ``item[i]`` and owns ``words[first[i]:first[i + 1]]``,
    of which those with ``is_key`` are its key words. Its words with a weight
    are the features of the latent space; the key words have numbers too.
    """

    def __init__(self, cut: list[tuple[int, np.ndarray]], df: np.ndarray, total: int, limits: Limits = LIMITS):
        """``cut`` as by ``cut_items``, ``df`` the frequency of each word among
        ``total`` half passages."""
        self.limits = limits
        self.item = np.array([i for i, _ in cut], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(w) for _, w in cut])]).astype(np.int64)
        self.words = np.concatenate([w for _, w in cut]).astype(np.int64)
        self.is_key = np.zeros(len(self.words), dtype=bool)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            own = np.unique(self.words[a:b])
            rare = own[np.lexsort((own, df[own]))][: limits.keys]
            self.is_key[a:b] = np.isin(self.words[a:b], rare)
        own = np.unique(self.words)
        idf = np.where(df[own] * limits.common_in > total, 0.0, np.log((total + 1) / (df[own] + 1)))
        self.features = own[idf > 0]
        self.idf = idf[idf > 0]
        self.keys = np.unique(self.words[self.is_key])
        self.vocabulary = len(df)

    def _numbers(self, words: np.ndarray) -> np.ndarray:
        out = np.full(self.vocabulary, -1, dtype=np.int64)
        out[words] = np.arange(len(words))
        return out

    @cached_property
    def feature_of(self) -> np.ndarray:
        """The feature of each word of the vocabulary, or -1."""
        return self._numbers(self.features)

    @cached_property
    def key_of(self) -> np.ndarray:
        return self._numbers(self.keys)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("feature_of", "key_of", "_pieces")}

    def __len__(self) -> int:
        return len(self.item)

    def piece(self, i: int) -> Piece:
        if "_pieces" not in self.__dict__:
            self._pieces: dict[int, Piece] = {}
        if i not in self._pieces:
            a, b = self.first[i], self.first[i + 1]
            words, key = self.words[a:b], self.is_key[a:b]
            self._pieces[i] = Piece(words.tolist(), words[key].tolist(), self.limits)
        return self._pieces[i]

    @cached_property
    def _entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece and feature of each word in its place."""
        piece = np.repeat(np.arange(len(self)), np.diff(self.first))
        f = self.feature_of[self.words]
        return piece[f >= 0], f[f >= 0]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The TF-IDF matrix of the pieces times ``x``."""
        row, f = self._entries
        out = np.zeros((len(self), x.shape[1]))
        np.add.at(out, row, self.idf[f, None] * x[f])
        return out

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        row, f = self._entries
        out = np.zeros((len(self.features), x.shape[1]))
        np.add.at(out, f, self.idf[f, None] * x[row])
        return out

    def energy(self) -> float:
        """Sum of the squares of the matrix."""
        row, f = self._entries
        d = max(1, len(self.features))
        cell, n = np.unique(row * d + f, return_counts=True)
        return float(((n * self.idf[cell % d]) ** 2).sum())

    def weighted(self, p: Part) -> tuple[np.ndarray, np.ndarray]:
        """Halves and features of the words of a part that weigh something."""
        f = self.feature_of[p.word]
        on = f >= 0
        return p.half[on], f[on]


def vocabulary_of(items: list[tuple[int, str]]) -> np.ndarray:
    """The hashes of the different words of items."""
    return np.unique(np.concatenate([*_hashes([t for _, t in items]), np.empty(0, np.uint64)]))


def cut_items(items: list[tuple[int, str]], words: Vocabulary, limits: Limits = LIMITS) -> list[tuple[int, np.ndarray]]:
    """The pieces of the items as numbers of words."""
    cut = []
    for (item, _), h in zip(items, _hashes([t for _, t in items]), strict=True):
        for part in np.array_split(words.find(h)[1], max(1, -(-len(h) // PIECE))):
            if len(part) >= max(1, limits.least_words):
                cut.append((item, part))
    return cut


#: Words that one round of work takes from a batch.
PART_WORDS = 1 << 18
STORED = "doc_id long, th long, n_words long, gaps binary, words binary"


def _encode(shared):
    """Gaps between, and numbers of, the known words of each text; ``shared`` is
    a broadcast of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(2), table=PLAIN):
                at, f = words.find(chunk.hashes)
                cut = np.searchsorted(at, chunk.first)
                place = at - np.repeat(chunk.first[:-1], np.diff(cut))
                gap = np.diff(place, prepend=0)
                start = cut[:-1][np.diff(cut) > 0]
                gap[start] = place[start]
                gap, f = gap.astype(np.uint32), f.astype(np.uint32)
                lo, n = chunk.rows.start, len(chunk.rows)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, n),
                        batch.column(1).slice(lo, n),
                        pa.array(np.diff(chunk.first)),
                        pa.array([gap[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([f[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=[c.split()[0] for c in STORED.split(", ")],
                )

    return run


class Part:
    """Some stored rows side by side: ``place`` and ``word`` of each known
    word, the half passage it is in, and the row of each half."""

    def __init__(self, start: int, n_words: np.ndarray, gaps: list[bytes], words: list[bytes]):
        self.start = start
        count = np.array([len(g) // 4 for g in gaps])
        self.first = np.concatenate([[0], np.cumsum(count)])
        total = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(gaps), dtype=np.uint32), dtype=np.int64)])
        self.place = total[1:] - np.repeat(total[self.first[:-1]], count)
        self.word = np.frombuffer(b"".join(words), dtype=np.uint32).astype(np.int64)
        self.n_words = n_words
        n_halves = -(-n_words // HALF)
        self.first_half = np.concatenate([[0], np.cumsum(n_halves)])
        self.half = np.repeat(self.first_half[:-1], count) + self.place // HALF
        self.row = np.repeat(np.arange(len(n_words)), n_halves)

    def region(self, r: int, at: int) -> tuple[list[int], list[int]]:
        """Known words of the passage at a word's place, and around it, with
        their places."""
        a, b = self.first[r], self.first[r + 1]
        lo, hi = np.searchsorted(self.place[a:b], (at - HALF // 2, at + 2 * HALF + HALF // 2))
        return self.word[a + lo : a + hi].tolist(), self.place[a + lo : a + hi].tolist()


def parts(batch: pa.RecordBatch) -> Iterator[Part]:
    n = batch.column(2).to_numpy(zero_copy_only=False)
    gaps, words = batch.column(3), batch.column(4)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), PART_WORDS, side="right")) + lo)
        yield Part(lo, n[lo:hi], gaps.slice(lo, hi - lo).to_pylist(), words.slice(lo, hi - lo).to_pylist())
        lo = hi


def _project(f: np.ndarray, half: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows of each half's words."""
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    if len(f):
        at = np.flatnonzero(np.diff(half, prepend=-1))
        out[half[at]] = np.add.reduceat(table[f], at, axis=0)
    return out


def _frequencies(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(d, dtype=np.int64), 0
        for batch in batches:
            for p in parts(batch):
                df += np.bincount(np.unique(p.half * d + p.word) % d, minlength=d)
                total += len(p.row)
        on = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(on, -1)), pa.array(np.append(df[on], total))], names=["feature", "n"])

    return run


def _range_part(shared):
    """This task's part of A^T (A R), a row a feature; ``shared`` is a broadcast
    of the queries and idf * R."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, table = shared.value
        y = np.zeros(table.shape)
        energy = 0.0
        for batch in batches:
            for p in parts(batch):
                half, f = q.weighted(p)
                if not len(f):
                    continue
                z = _project(f, half, len(p.row), table)
                order = np.argsort(f, kind="stable")
                g = f[order]
                first = np.flatnonzero(np.diff(g, prepend=-1))
                y[g[first]] += np.add.reduceat(z[half[order]], first, axis=0)
                energy += float((q.idf[f] ** 2).sum())
        y *= q.idf[:, None]
        on = np.flatnonzero(np.abs(y).max(axis=1)) if y.size else np.empty(0, np.int64)
        values = np.concatenate([y[on].reshape(-1), np.full(table.shape[1], energy)]).astype(np.float32)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(values), table.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.record_batch([pa.array(np.append(on, -1)), rows], names=["feature", "y"])

    return run


@dataclass
class Latent:
    """A basis of the leading right singular vectors, and the singular values."""

    basis: np.ndarray
    values: np.ndarray


def nystroem(y: np.ndarray, start: np.ndarray, rank: int) -> Latent:
    """Leading eigenpairs of a positive matrix C from ``y = C @ start``."""
    core = start.T @ y
    core = (core + core.T) / 2
    shift = max(0.0, -float(np.linalg.eigvalsh(core)[0])) + 1e-9 * max(float(np.trace(core)) / len(core), 1e-30)
    left = np.linalg.cholesky(core + shift * np.eye(len(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(left, y.T).T, full_matrices=False)
    return Latent(u[:, :rank], s[:rank])


def count_words(stored: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """The frequency of each of ``d`` words, and the number of half passages."""
    counts = stored.mapInArrow(_frequencies(d), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    t = counts.toArrow()  # a row a word of the benchmark, as arrays
    f, n = t["feature"].to_numpy(), t["n"].to_numpy()
    df = np.zeros(d, dtype=np.int64)
    df[f[f >= 0]] = n[f >= 0]
    return df, int(n[f < 0].sum())


def fit_latent(stored: DataFrame, q: Queries, rank: int = RANK, seed: int = 3) -> Latent:
    """Randomised SVD over all half passages."""
    d = len(q.features)
    if not d:
        return Latent(np.zeros((0, 1)), np.zeros(1))
    width = min(d, rank + OVERSAMPLE)
    start = np.random.default_rng(seed).normal(size=(d, width))
    shared = stored.sparkSession.sparkContext.broadcast((q, (q.idf[:, None] * start).astype(np.float32)))
    sent = stored.mapInArrow(_range_part(shared), "feature long, y array<float>")
    total = sent.groupBy("feature").agg(F.array(*[F.sum(F.col("y")[i]).cast("float") for i in range(width)]).alias("y"))
    t = total.toArrow().combine_chunks()  # a row a feature, as arrays
    y, energy = np.zeros((d, width)), 0.0
    if t.num_rows:
        f, values = t["feature"].to_numpy(), pc.list_flatten(t["y"]).to_numpy().reshape(-1, width)
        y[f[f >= 0]] = values[f >= 0]
        energy = float(values[f < 0][0, 0])
    weight = energy / max(q.energy(), 1e-30) if energy else 1.0
    return nystroem(y + weight * q.transposed_times(q.times(start)), start, rank)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class Search:
    """What a task needs to find a block of items: the latent basis, the pieces
    in it, and the pieces of each key word with its number of places in them."""

    def __init__(self, q: Queries, latent: Latent):
        self.q = q
        self.table = (q.idf[:, None] * latent.basis).astype(np.float32)
        self.target = _unit(q.times(latent.basis).astype(np.float32))
        piece = np.repeat(np.arange(len(q)), np.diff(q.first))[q.is_key]
        f = q.key_of[q.words[q.is_key]]
        cell, times = np.unique(f * len(q) + piece, return_counts=True)
        f, self.piece = np.divmod(cell, len(q))
        self.times = times
        self.first = np.searchsorted(f, np.arange(len(q.keys) + 1))
        # How many of the key words, with repeats, a copy and a paraphrase have at least.
        n = np.bincount(piece, minlength=len(q))
        short = np.diff(q.first) < q.limits.short
        self.copy = np.where(short, n, np.ceil(q.limits.loose * n))
        long = np.diff(q.first) >= 2 * q.limits.keys
        self.paraphrase = np.where(long, np.ceil(n / 3), np.inf)

    def candidates(self, region: np.ndarray, f: np.ndarray, latent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Regions, pieces and cosines of the candidates, from the different key
        words ``f`` of each region, sorted by region, and the latent vectors of
        all passages. A candidate by its cosine that lacks key words which the
        confirmation asks for is left out here already."""
        n = len(self.copy)
        start = np.flatnonzero(np.diff(region, prepend=-1))
        count = np.diff(self.first)[f]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.append(start, len(region))
        lo = 0
        while lo < len(start):
            hi = int(np.searchsorted(total[ends], total[ends[lo]] + SHARED, side="right")) - 1
            hi = max(lo + 1, min(hi, lo + max(1, SHARED // n), len(start)))
            a, b = ends[lo], ends[hi]
            own = np.repeat(np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), count[a:b])
            at = np.arange(total[b] - total[a]) + np.repeat(self.first[f[a:b]] - (total[a:b] - total[a]), count[a:b])
            shared = np.bincount(own * n + self.piece[at], self.times[at], (hi - lo) * n).reshape(hi - lo, n)
            near = latent[region[start[lo:hi]]] @ self.target.T
            i, k = np.nonzero((shared >= self.copy) | ((near >= self.q.limits.near) & (shared >= self.paraphrase)))
            yield region[start[lo + i]], k, near[i, k]
            lo = hi

    def regions(self, p: Part) -> tuple[np.ndarray, np.ndarray]:
        """Halves at which a passage starts, and the different key words of the
        passage and its surroundings, sorted."""
        f = self.q.key_of[p.word]
        on = np.flatnonzero(f >= 0)
        row = p.row[p.half[on]]
        last = p.half[on] + (p.place[on] % HALF >= HALF // 2)
        keys = []
        for back in range(3):
            h = last - back
            ok = (h >= p.first_half[row]) & (h < p.first_half[row + 1])
            keys.append(h[ok] * len(self.q.keys) + f[on][ok])
        return np.divmod(np.unique(np.concatenate(keys)), len(self.q.keys))

    def passages(self, p: Part) -> np.ndarray:
        """The unit latent vectors of the passages, one a half that begins one."""
        half, f = self.q.weighted(p)
        z = _project(f, half, len(p.row), self.table)
        if len(z):
            z[:-1] += z[1:] * (p.row[1:] == p.row[:-1])[:, None]
        return _unit(z)

    def matches(self, p: Part) -> Iterator[tuple[int, int, float, int, float]]:
        """Row, piece, common part, word place and cosine of each match."""
        regions = self.regions(p)
        if not len(regions[0]):
            return
        last, region = -1, ([], [])
        for halves, pieces, near in self.candidates(*regions, self.passages(p)):
            for h, k, c in zip(halves.tolist(), pieces.tolist(), near.tolist(), strict=True):
                r = int(p.row[h])
                at = (h - int(p.first_half[r])) * HALF
                if h != last:
                    last, region = h, p.region(r, at)
                share, ok = self.q.piece(k).matches(*region, c)
                if ok:
                    yield r, k, share, at, c


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(*shared.value)
        for batch in batches:
            for p in parts(batch):
                best: dict[tuple[int, int], tuple] = {}
                for r, k, share, at, near in s.matches(p):
                    key, value = (r, int(s.q.item[k])), (share, -at, near)
                    if key not in best or value > best[key]:
                        best[key] = value
                if not best:
                    continue
                out = [(p.start + r, i, share, -at, near) for (r, i), (share, at, near) in sorted(best.items())]
                take, item, share, at, near = zip(*out, strict=True)
                take = pa.array(take, pa.int64())
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(item, pa.int64()),
                     pa.array(share, pa.float64()), pa.array(at, pa.int32()), pa.array(near, pa.float64())],
                    names=["doc_id", "th", "item_id", "share", "at_word", "cosine"],
                )

    return run


def _benchmarks(rows: DataFrame) -> Iterator[tuple[Vocabulary, list[list[tuple[int, str]]]]]:
    """The items in blocks, as benchmarks of a bounded vocabulary."""
    words, blocks = np.empty(0, np.uint64), [[]]

    def add() -> None:
        nonlocal words
        words = np.union1d(words, vocabulary_of(blocks[-1]))

    for r in rows.toLocalIterator():
        blocks[-1].append((r[0], r[1]))
        if len(blocks[-1]) == BLOCK_ITEMS:
            add()
            if len(words) > VOCABULARY:
                yield Vocabulary(words), blocks
                words, blocks = np.empty(0, np.uint64), []
            blocks.append([])
    add()
    yield Vocabulary(words), blocks


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, limits: Limits = LIMITS
) -> DataFrame:
    """``doc_id, th, item_id, share, at_word, cosine``: a row for each document
    and item that match, with the best passage (first of equals), the part of
    the item's piece that it has in common, and their latent cosine."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = "doc_id long, th long, item_id long, share double, at_word int, cosine double"
    found = spark.createDataFrame([], schema)
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text")
    for words, blocks in _benchmarks(rows):
        cuts = [cut for b in blocks if (cut := cut_items(b, words, limits))]
        if not cuts:
            continue
        # A vocabulary of at most VOCABULARY words and a block's more.
        stored = materialize(src.mapInArrow(_encode(spark.sparkContext.broadcast(words)), STORED), "leak-words")
        df, total = count_words(stored, len(words))
        for cut in cuts:
            q = Queries(cut, df, total, limits)
            shared = spark.sparkContext.broadcast((q, fit_latent(stored, q, rank)))
            part = stored.mapInArrow(_search(shared), schema).dropDuplicates(["doc_id", "th", "item_id"])
            found = found.unionByName(materialize(part, "leaks"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that match a benchmark item."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__th"))
    return docs.join(leaks.hint("shuffle_hash"), same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("share", 6).alias("share"), "at_word", F.round("cosine", 6).alias("cosine"))
