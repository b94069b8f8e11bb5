"""Repeated passages by a relative Lempel-Ziv parse.

The reference is the corpus itself, every piece of it once: documents are cut
into blocks by their content, and of equal blocks the reference has that of the
smallest document at its first place there.

* A window is ``window`` consecutive words. Its anchor is the word gram with
  the least hash in it, so equal windows have equal anchors wherever they lie.
* Every ``CUT``-th anchor, by other bits of its hash, begins a block. A block is
  indexed with the ``window - 1`` words that follow it, so each window lies in
  exactly one block, that in which it starts.

A document is parsed against the reference from left to right. Where a smaller
document has its block, that is a match with a source and a place there; the
factor goes on as long as the blocks that follow are the next ones at the same
source. As the reference has every block once, that is the longest match, and
there is no choice. Where no block matches, a factor ended inside a block or
begins inside one: at these boundaries windows are looked up one by one, each
again with its first place in the corpus; only those are hashed whose anchor
occurs in another document as well. Windows that go on along one source make a
factor, or extend that beside them. Factors of at least a window, which all of
them are, become duplicate spans.

That loses nothing: the smallest document that holds a window never has it in a
factor of blocks, for the factor's source would be smaller still. So the windows
outside factors hold at least one copy from that smallest document.

Block and window keys are 128 bits wide. Defined results: null, empty and blank
texts have no words; texts shorter than a window keep all. Rows with the same
id never remove words of each other. Rows with a null id keep all words and
are no reference. Repeated rows each appear in the result. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Chunk, chunks, materialize, mix, powers, read_table

GRAM = 10
#: Anchors to a block, a power of two; a block has about 20 times as many words.
CUT = 8
_BASE_1 = 0x2545F4914F6CDD1D
_BASE_2 = 0x9FB21C651E98DF25
_POS = U64(0xFFFFFFFF)
_HIGH = U64(0xFFFFFFFF00000000)


class Parsed:
    """Window keys, anchors and blocks of a chunk's rows."""

    def __init__(self, chunk: Chunk, window: int):
        w = chunk.hashes
        n = len(w)
        self.first = chunk.first
        self.window = window
        gram = min(GRAM, window)
        span = window - gram + 1
        with np.errstate(over="ignore"):
            self.inv = [powers(pow(b, -1, 1 << 64), n + 1) for b in (_BASE_1, _BASE_2)]
            self.sums = []
            for b in (_BASE_1, _BASE_2):
                s = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(w * powers(b, n), out=s[1:])
                self.sums.append(s)
        self.grams = self.keys(0, np.arange(0, max(0, n - gram + 1)), gram)
        # The least gram of each window, the first of equals.
        least = (self.grams & _HIGH) | np.arange(len(self.grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span and len(least):
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        if span > width and len(least):
            gap = span - width
            least = np.minimum(least[:-gap], least[gap:]) if len(least) > gap else least[:0]
        self.anchor = (least & _POS).astype(np.int64)
        # The range of window starts of each row.
        self.lo = self.first[:-1]
        self.hi = np.maximum(self.first[1:] - window + 1, self.lo)

    def keys(self, which: int, start: np.ndarray, length) -> np.ndarray:
        s = self.sums[which]
        with np.errstate(over="ignore"):
            return mix((s[start + length] - s[start]) * self.inv[which][start] + np.asarray(length, dtype=np.uint64))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the blocks, and the ranges of window starts that make them."""
        at = self.starts()
        anchor = self.anchor[at]
        # Anchors only go forward, so each is a run.
        cut = anchor[np.diff(anchor, prepend=-1) > 0]
        cut = np.unique(cut[(self.grams[cut] & U64(CUT - 1)) == 0])
        row = self.row_of(cut)
        cut = cut[(cut > self.lo[row]) & (cut < self.hi[row])]
        lo = np.union1d(self.lo[self.hi > self.lo], cut).astype(np.int64)
        row = self.row_of(lo)
        hi = np.minimum(np.append(lo[1:], len(self.anchor) + 1), self.hi[row])
        return row, lo, hi

    def starts(self) -> np.ndarray:
        """All window starts of all rows."""
        count = self.hi - self.lo
        return np.repeat(self.lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _lists(values: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    """``values``, sorted by ``row``, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _indexer(window: int):
    """One row a document: its digest, and the keys of its blocks and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                p = Parsed(chunk, window)
                raw = chunk.buf.tobytes()
                sha = []
                for r in range(len(chunk.rows)):
                    s, e = chunk.spans(r)
                    sha.append(hashlib.sha256(b" ".join(raw[s[0] : e[-1]].split()) if len(s) else b"").digest())
                row, lo, hi = p.blocks()
                length = hi - lo + window - 1
                base = p.first[row]
                blocks = pa.StructArray.from_arrays(
                    [
                        pa.array(p.keys(0, lo, length).view(np.int64)),
                        pa.array(p.keys(1, lo, length).view(np.int64)),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                    ],
                    names=["k1", "k2", "lo", "hi"],
                )
                at = p.starts()
                block = np.searchsorted(lo, at, side="right") - 1
                turn = (np.diff(block, prepend=-1) > 0) | (np.diff(p.anchor[at], prepend=-1) > 0)
                at, block = at[turn], block[turn]
                anchors = pa.StructArray.from_arrays(
                    [pa.array((lo[block] - p.first[row[block]]).astype(np.int32)), pa.array(p.grams[p.anchor[at]].view(np.int64))],
                    names=["lo", "gram"],
                )
                size = len(chunk.rows)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.rows.start, size),
                        batch.column(1).slice(chunk.rows.start, size),
                        pa.array(np.diff(p.first)),
                        pa.array(sha, pa.binary()),
                        _lists(blocks, row, size),
                        _lists(anchors, row[block], size),
                    ],
                    names=["doc_id", "th", "n_words", "sha", "blocks", "anchors"],
                )

    return run


_INDEX = (
    "doc_id long, th long, n_words long, sha binary, "
    "blocks array<struct<k1:long,k2:long,lo:int,hi:int>>, anchors array<struct<lo:int,gram:long>>"
)
#: A match: words from ``lo`` whose windows start before ``hi``, equal to those
#: at ``at`` of the text ``source_th`` of document ``source``.
_MATCH = "array<struct<lo:int,hi:int,source:long,source_th:long,at:int>>"


def _open_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different anchors of a document's blocks without a match."""
    for batch in batches:
        row, out = [], []
        for r in range(batch.num_rows):
            anchors, matches = batch.column(2)[r].values, batch.column(3)[r].values
            gram = anchors.field("gram").to_numpy()
            if matches is not None and len(matches):
                gram = gram[~np.isin(anchors.field("lo").to_numpy(), matches.field("lo").to_numpy())]
            out.append(np.unique(gram))
            row.append(np.full(len(out[-1]), r))
        if out:
            take = pa.array(np.concatenate(row).astype(np.int64))
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(out))], names=["doc_id", "th", "anchor"])


def _open_windows(window: int):
    """Keys of the windows outside factors whose anchor another document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0), batch.column(1)
            spans, shared = batch.column(3), batch.column(4)
            for chunk in chunks(batch.column(2)):
                p = Parsed(chunk, window)
                row, start = [], []
                for r in range(len(chunk.rows)):
                    known = shared[chunk.rows.start + r].values
                    if known is None or not len(known):
                        continue
                    lo, hi = p.lo[r], p.hi[r]
                    known = known.to_numpy(zero_copy_only=False).view(np.uint64)
                    want = np.isin(p.grams[p.anchor[lo:hi]], known)
                    matches = spans[chunk.rows.start + r].values
                    if matches is not None:
                        want &= ~_cover(hi - lo, matches.field("lo").to_numpy(), matches.field("hi").to_numpy())
                    at = np.flatnonzero(want)
                    row.append(np.full(len(at), chunk.rows.start + r))
                    start.append(at + lo)
                if not row:
                    continue
                row, start = np.concatenate(row), np.concatenate(start)
                take = pa.array(row)
                yield pa.record_batch(
                    [
                        pa.array(p.keys(0, start, window).view(np.int64)),
                        pa.array(p.keys(1, start, window).view(np.int64)),
                        ids.take(take),
                        ths.take(take),
                        pa.array((start - p.first[row - chunk.rows.start]).astype(np.int32)),
                    ],
                    names=["k1", "k2", "doc_id", "th", "start"],
                )

    return run


def _cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    step = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(hi, n), minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def factors(lo: np.ndarray, hi: np.ndarray, source: np.ndarray, source_th: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The greedy parse: where, among matches in order, a factor begins.

    A match goes on with the factor before it if it begins where that ends and
    is what follows at the same source.
    """
    if not len(lo):
        return np.empty(0, dtype=np.int64)
    on = (lo[1:] == hi[:-1]) & (source[1:] == source[:-1]) & (source_th[1:] == source_th[:-1]) & (at[1:] - lo[1:] == at[:-1] - lo[:-1])
    return np.flatnonzero(np.concatenate([[True], ~on]))


def _columns(matches: pa.StructArray | None) -> list[np.ndarray]:
    names = ("lo", "hi", "source", "source_th", "at")
    if matches is None:
        return [np.empty(0, dtype=np.int64)] * len(names)
    return [matches.field(c).to_numpy().astype(np.int64) for c in names]


_CUT = (
    "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,stop:int>>, "
    "factors array<struct<start:int,stop:int,source:long,at:int>>"
)


def _cutter(window: int):
    """Texts without their duplicate words, joined by one space, the spans, and
    the factors that make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                raw = chunk.buf.tobytes()
                ids, n, removed, text = [], [], [], []
                edges, parsed = [], []
                for r in range(len(chunk.rows)):
                    i = chunk.rows.start + r
                    s, e = chunk.spans(r)
                    m = [np.concatenate(c) for c in zip(_columns(batch.column(3)[i].values), _columns(batch.column(4)[i].values), strict=True)]
                    order = np.argsort(m[0], kind="stable")
                    lo, hi, source, source_th, at = (c[order] for c in m)
                    gone = _cover(len(s), lo, hi + window - 1)
                    words = raw[s[0] : e[-1]].split()
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    text.append(b" ".join(itertools.compress(words, ~gone)).decode())
                    edges.append(np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).astype(np.int32))
                    first = factors(lo, hi, source, source_th, at)
                    stop = hi[np.append(first[1:], len(hi)) - 1] + window - 1
                    parsed.append((lo[first], stop, source[first], at[first]))
                start, stop, source, at = (np.concatenate(c) for c in zip(*parsed, strict=True))
                edge = np.concatenate(edges)
                rows = np.arange(len(n))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.rows.start, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(text, pa.string()),
                        _lists(
                            pa.StructArray.from_arrays([pa.array(edge[::2]), pa.array(edge[1::2])], names=["start", "stop"]),
                            np.repeat(rows, [len(x) // 2 for x in edges]),
                            len(n),
                        ),
                        _lists(
                            pa.StructArray.from_arrays(
                                [pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(source), pa.array(at.astype(np.int32))],
                                names=["start", "stop", "source", "at"],
                            ),
                            np.repeat(rows, [len(x[0]) for x in parsed]),
                            len(n),
                        ),
                    ],
                    names=["doc_id", "n_words", "n_removed", "text", "spans", "factors"],
                )

    return run


def _matches(pieces: DataFrame, name: str) -> DataFrame:
    """``doc_id, th, matches`` of ``doc_id, th, k1, k2, lo, hi``: the pieces that
    a smaller document has, with their first place there, in order."""
    first = pieces.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "lo")).alias("first"), F.max("doc_id").alias("last"))
    # Stored, the aggregate meets its rows in a join that Spark can split at hot keys.
    first = materialize(first.where("first.doc_id < last").select("k1", "k2", "first"), f"{name}-first")
    found = pieces.join(first, ["k1", "k2"]).where("first.doc_id < doc_id")
    match = F.struct("lo", "hi", F.col("first.doc_id").alias("source"), F.col("first.th").alias("source_th"), F.col("first.lo").alias("at"))
    # Repeated rows give a match each time, of which one stays.
    return found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(match)).alias("matches"))


def _parse(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The index rows of all documents; the cut texts of those with duplicates."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("th"), "text")
    index = materialize(src.mapInArrow(_indexer(window), _INDEX), "rlz-index")
    named = index.where("doc_id IS NOT NULL AND size(blocks) > 0")

    # Matches of whole blocks.
    block = named.select("doc_id", "th", F.inline("blocks"))
    matched = materialize(_matches(block, "rlz-blocks"), "rlz-matches")

    # Anchors of the remaining blocks that occur in several documents.
    rest = named.select("doc_id", "th", "anchors").join(matched, ["doc_id", "th"], "left")
    anchor = materialize(rest.mapInArrow(_open_anchors, "doc_id long, th long, anchor long"), "rlz-open-anchors")
    shared = anchor.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    shared = materialize(shared, "rlz-anchors")
    wanted = anchor.join(shared, "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors"))

    # Texts that matter further travel once; the join builds on the narrow side.
    marks = wanted.join(matched, ["doc_id", "th"], "full_outer")
    marked = materialize(
        src.join(marks.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "matches", "anchors"),
        "rlz-texts",
    )
    opened = materialize(
        marked.where("anchors IS NOT NULL").mapInArrow(_open_windows(window), "k1 long, k2 long, doc_id long, th long, start int"),
        "rlz-windows",
    )
    windows = opened.select("k1", "k2", "doc_id", "th", F.col("start").alias("lo"), (F.col("start") + 1).alias("hi"))
    ends = materialize(_matches(windows, "rlz-windows").withColumnRenamed("matches", "ends"), "rlz-ends")
    found = marked.join(ends.hint("shuffle_hash"), ["doc_id", "th"], "left").where("matches IS NOT NULL OR ends IS NOT NULL")
    cut = found.select("doc_id", "th", "text", "matches", "ends").mapInArrow(_cutter(window), _CUT)
    touched = matched.select("doc_id", "th").unionByName(ends.select("doc_id", "th")).distinct()
    return index.join(touched, ["doc_id", "th"], "left_anti"), cut


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, text, spans, factors`` for documents with
    duplicates.

    ``text`` has the kept words joined by one space; ``spans`` are word ranges
    that are covered by windows of smaller documents; ``factors`` are those of
    the parse, word ranges with the document and the word that they are equal
    to. Neighbouring factors overlap by up to a window less a word, those in
    which the windows across their boundary lie.
    """
    return _parse(docs, id_col, text_col, window)[1]


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, cut = _parse(read_table(spark, sf_dir, "documents"), "doc_id", "text", 50)
    return whole.select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256")
    ).unionByName(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")))
