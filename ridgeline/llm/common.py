"""Shared helpers: scratch tables, word hashing over Arrow buffers, components.

Words are the runs of bytes other than space and 0x09-0x0D. UTF-8 never uses
those bytes inside a longer character, so tokenising works on raw bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import runtime
from ridgeline.runtime import scratch_path  # noqa: F401

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)

#: Bytes of text hashed at once; bounds the memory of the per-byte arrays.
HASH_BLOCK = 1 << 19
#: Bytes of text that one round of per-document work takes from a batch.
CHUNK_BYTES = 1 << 20


# --------------------------------------------------------------------------
# scratch tables


#: Rows that Spark hands to Python at once. Texts are long, and each batch lies
#: in memory several times: Spark's default of 10,000 rows takes up to 64 MB each.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Hand smaller batches to Python from now on, unless the session sets less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``runtime.materialize``, with batches bounded for the Python in ``df``.

    The bound holds for the session from its first call on: Spark reads it when
    a plan runs, which for a result of this package is after it was returned.
    """
    bound_batches(df.sparkSession)
    return runtime.materialize(df, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# hashing


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


_BYTE_BASE = 0x5851F42D4C957F2D
_BYTE_INV = pow(_BYTE_BASE, -1, 1 << 64)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_tables: dict[str, np.ndarray] = {}


def _byte_powers() -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables:
        _tables["pow"] = powers(_BYTE_BASE, 2 * HASH_BLOCK)
        _tables["inv"] = powers(_BYTE_INV, 2 * HASH_BLOCK)
    return _tables["pow"], _tables["inv"]


def find_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte positions of the words of a buffer."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, a polynomial over a random value per byte."""
    pw, inv = _byte_powers()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        if ends[i] - base > HASH_BLOCK:
            word = hashlib.blake2b(buf[base : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(word, dtype=np.uint64)[0]
            i += 1
            continue
        j = int(np.searchsorted(ends, base + HASH_BLOCK, side="right"))
        j = max(j, i + 1)
        stop = ends[j - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[buf[base:stop]] * pw[: stop - base], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * _GOLDEN)
        i = j
    return out


class Chunk:
    """Some rows of a batch: ids, and the word hashes of their texts end to end.

    Row ``r`` owns the words ``first[r]:first[r + 1]``.
    """

    __slots__ = ("rows", "buf", "offsets", "starts", "ends", "first", "_hashes")

    def __init__(self, rows: range, buf: np.ndarray, offsets: np.ndarray):
        self.rows = rows
        self.buf = buf
        self.offsets = offsets
        # Rows lie side by side without a separator, so cut words at row starts.
        starts, ends = find_words(buf)
        inner = offsets[1:-1]
        if len(starts) and len(inner):
            at = np.searchsorted(starts, inner, side="left") - 1
            cut = np.unique(inner[(at >= 0) & (starts[at] < inner) & (ends[at] > inner)])
            if len(cut):
                starts = np.sort(np.concatenate([starts, cut]))
                ends = np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets, side="left")
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = hash_words(self.buf, self.starts, self.ends)
        return self._hashes

    def text(self, r: int) -> bytes:
        return self.buf[self.offsets[r] : self.offsets[r + 1]].tobytes()

    def words(self, r: int) -> list[bytes]:
        raw = self.buf
        return [raw[s:e].tobytes() for s, e in zip(*self.spans(r), strict=True)]

    def spans(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[r], self.first[r + 1]
        return self.starts[a:b], self.ends[a:b]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


#: Lower-cases A-Z and turns ASCII punctuation into blanks.
PLAIN = _LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def chunks(col: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, table: np.ndarray | None = None) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes, a row at least.

    ``table`` maps bytes before words are found; ``lower`` is short for A-Z.
    """
    table = _LOWER if lower else table
    if not len(col):
        return
    raw, offsets = string_buffers(col)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        buf = raw[offsets[lo] : offsets[hi]]
        yield Chunk(range(lo, hi), buf if table is None else table[buf], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row, as 64-bit hashes.

    A row with fewer than k words has its whole sequence as the one shingle; a
    row without words has none.
    """
    with np.errstate(over="ignore"):
        n = len(words)
        if n >= k:
            acc = np.zeros(n - k + 1, dtype=np.uint64)
            for i in range(k):
                acc = acc * U64(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
            acc = mix(acc)
        else:
            acc = np.empty(0, dtype=np.uint64)
        out = []
        for r in range(len(first) - 1):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                s = np.sort(acc[a : b - k + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), dtype=bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
            elif b > a:
                h = U64(b - a)
                for w in words[a:b]:
                    h = h * U64(0xD6E8FEB86659FD93) + w
                s = mix(np.array([h ^ _GOLDEN], dtype=np.uint64))
            else:
                s = np.empty(0, dtype=np.uint64)
            out.append(s)
    return out


def window_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        pw = powers(base, len(words))
        inv = powers(pow(base, -1, 1 << 64), n)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * pw, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * inv)


# --------------------------------------------------------------------------
# connected components


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The least node reachable from each node: ``node``, ``component``.

    ``edges`` has two long columns ``a`` and ``b``; null ends and loops are
    left out, and so is a node without an edge. Alternates large-star and
    small-star steps, each a stored aggregate of minima joined back: Spark
    splits a join at a hot key only where both sides come straight from a
    shuffle, so the centre of a huge star needs its minimum stored first.
    """
    e = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    last = state(e)
    while last[0]:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, name)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = materialize(small, name)
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
