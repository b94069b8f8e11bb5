"""Near-duplicate vectors by quantised tiles with rigorous error bounds.

Every unit vector is rounded to int8 with its own scale, and the norm of what
rounding took away is kept. With ``x = X + ex`` and ``y = Y + ey``,

    |x.y - X.Y|  <=  |X| |ey| + |ex| |y|

holds for every pair, so products of the codes tell which pairs surely reach
the threshold and which surely do not. The distinct vectors of one label and
length are dealt into blocks, and each pair of blocks is a tile of bounded
size. What travels to the tiles is the codes, a byte a component.

1. A tile multiplies codes. Pairs that surely reach the threshold are links at
   once; vectors with a pair for which the bounds leave it open are named.
2. Only these vectors' full components travel to their tile again, and their
   open pairs are recomputed in double precision.

Codes are multiplied as float32, whose products of codes are exact up to 1024
components; longer vectors use float64. So both passes see the same bounds.

A tile gives each vector its number of links and one link to the least vector
of its component within the tile; pairs are never emitted. Equal vectors of a
label are one vector with a count before they meet, so a large group of copies
costs one row. Distinct vectors are told apart by a number of their own, not by
their id, so an id that occurs twice, also under two labels, joins nothing.
Equality is that of 128 bits of hashes of the label and the components.

Defined results: vectors that are null, empty, zero, or that hold null or
non-finite components, and rows with a null label or id, link with nothing and
are kept. Vectors of different lengths never link. Repeated rows count as
further vectors. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, materialize, read_table

#: Distinct vectors of a block; a tile holds two blocks' codes.
BLOCK = 2048
#: Rows of a tile that are multiplied at once.
STRIP = 256
#: Slack for the rounding of the bound's own arithmetic.
SLACK = 1e-6
PAIRS = 1 << 16


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of the rounding errors, rounded up.

    Scales and norms are values of float32, so they are the same after a
    journey as four bytes.
    """
    scale = (np.abs(unit).max(axis=1) / 127.0).astype(np.float32)
    scale[scale == 0] = 1.0
    code = np.clip(np.rint(unit / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    error = np.linalg.norm(unit - code * scale[:, None].astype(np.float64), axis=1)
    return code, scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


class Codes:
    """The quantised rows of a tile's side."""

    def __init__(self, code: np.ndarray, scale: np.ndarray, error: np.ndarray):
        kind = np.float32 if code.shape[1] <= 1024 else np.float64
        self.code = code.astype(kind)
        self.scale = scale.astype(np.float64)
        self.norm = np.sqrt((self.code.astype(np.float64) ** 2).sum(axis=1)) * self.scale
        self.error = error.astype(np.float64)

    def __len__(self) -> int:
        return len(self.scale)

    def __getitem__(self, rows) -> Codes:
        out = object.__new__(Codes)
        out.code, out.scale, out.norm, out.error = self.code[rows], self.scale[rows], self.norm[rows], self.error[rows]
        return out


def judge(a: Codes, b: Codes | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b) that may have a cosine of ``threshold`` or more,
    and whether they surely do; with ``b`` None, pairs i < j within a."""
    same = b is None
    b = a if same else b
    for lo in range(0, len(a), STRIP):
        s = a[lo : lo + STRIP]
        about = (s.code @ b.code.T).astype(np.float64) * s.scale[:, None] * b.scale[None, :]
        off = s.norm[:, None] * b.error[None, :] + s.error[:, None] * (b.norm + b.error)[None, :] + SLACK
        i, j = np.nonzero(about + off >= threshold)
        if same:
            up = j > i + lo
            i, j = i[up], j[up]
        yield i + lo, j, about[i, j] - off[i, j] >= threshold


def least_reachable(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least index in each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Links:
    """Link counts and the components of a tile, strip by strip."""

    def __init__(self, copies: np.ndarray):
        self.copies = copies
        self.links = np.zeros(len(copies), dtype=np.int64)
        self.root = np.arange(len(copies))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        if not len(p):
            return
        n = len(self.copies)
        self.links += np.bincount(p, self.copies[q], n).astype(np.int64) + np.bincount(q, self.copies[p], n).astype(np.int64)
        # Pairs that earlier strips have joined add nothing to the components.
        new = self.root[p] != self.root[q]
        if new.any():
            at = np.arange(n)
            self.root = least_reachable(n, np.concatenate([at, p[new]]), np.concatenate([self.root, q[new]]))

    def frame(self, pdf: pd.DataFrame, open_: np.ndarray | None = None) -> pd.DataFrame:
        """The rows that have links, or are open, with a link to their head."""
        vid = pdf["vid"].to_numpy()
        out = pd.DataFrame({"vid": vid, "links": self.links, "head": vid[self.root]})
        if open_ is None:
            return out[self.links > 0]
        return out.assign(open=open_, i=pdf["i"], j=pdf["j"], side=pdf["side"])[(self.links > 0) | open_]


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Codes, int | None]:
    """Rows by side and number, their codes, and where the second side begins,
    or None if the tile is of one block."""
    pdf = pdf.sort_values(["side", "vid"], ignore_index=True)
    side = pdf["side"].to_numpy()
    code = np.frombuffer(b"".join(pdf["code"]), dtype=np.int8).reshape(len(pdf), -1)
    return pdf, Codes(code, pdf["scale"].to_numpy(), pdf["error"].to_numpy()), None if (side == 1).all() else int((side == 0).sum())


def _judged(c: Codes, k: int | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``judge`` over a tile's rows, of which the second side begins at ``k``."""
    for p, q, sure in judge(c, None, threshold) if k is None else judge(c[:k], c[k:], threshold):
        yield p, q if k is None else q + k, sure


def _coarse(threshold: float):
    """Sure links of a tile, and the vectors with open pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, c, k = _sides(pdf)
        out, open_ = Links(pdf["copies"].to_numpy()), np.zeros(len(pdf), dtype=bool)
        for p, q, sure in _judged(c, k, threshold):
            out.add(p[sure], q[sure])
            open_[p[~sure]] = open_[q[~sure]] = True
        return out.frame(pdf, open_)

    return run


def exact_links(x: np.ndarray, c: Codes, k: int | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The open pairs that are links, by the unit rows ``x`` in doubles."""
    for p, q, sure in _judged(c, k, threshold):
        p, q = p[~sure], q[~sure]
        for at in range(0, len(p), PAIRS):
            a, b = p[at : at + PAIRS], q[at : at + PAIRS]
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            yield a[hit], b[hit]


def _fine(threshold: float, kind: str):
    """Links among the open pairs of a tile, from full vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, c, k = _sides(pdf)
        x = unit_rows(np.frombuffer(b"".join(pdf["full"]), dtype=kind).reshape(len(pdf), -1))
        out = Links(pdf["copies"].to_numpy())
        for p, q in exact_links(x, c, k, threshold):
            out.add(p, q)
        return out.frame(pdf)

    return run


def _packer(kind: str):
    """A vector's bytes, or null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column(2):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                packed.append(None if x is None else x.astype(kind).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["vec_id", "label", "full"])

    return run


def _quantiser(kind: str):
    """Numbers of distinct vectors with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "full", "rep", "copies", "vid", "dim", "k1", "k2"]
        for batch in batches:
            full = batch.column(1).to_pylist()
            code, scale, error = [b""] * len(full), np.zeros(len(full), np.float32), np.zeros(len(full), np.float32)
            size = np.array([len(v) for v in full])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = unit_rows(np.frombuffer(b"".join(full[i] for i in at), dtype=kind).reshape(len(at), -1))
                c, scale[at], error[at] = quantise(x)
                for i, row in zip(at, c, strict=True):
                    code[i] = row.tobytes()
            yield pa.record_batch(
                [*batch.columns, pa.array(code, pa.binary()), pa.array(scale), pa.array(error)], names=[*names, "code", "scale", "error"]
            )

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    element = vectors.schema[vector_col].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = "float32" if single else "float64"
    src = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"),
    )
    packed = src.mapInArrow(_packer(kind), "vec_id long, label string, full binary")
    live = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND full IS NOT NULL")
    # Equal vectors of a label meet by 128 bits, so the vectors themselves travel once.
    key = ["k1", "k2"]
    packed = packed.withColumns({"k1": F.when(live, F.xxhash64("label", "full")), "k2": F.when(live, F.xxhash64(F.lit(7), "full", "label"))})
    packed = materialize(packed, "vectors")
    one = packed.where(live).groupBy(*key).agg(
        F.first("label").alias("label"), F.first("full").alias("full"), F.min("vec_id").alias("rep"), F.count("*").alias("copies")
    )
    # The number is stored with its vector, so no later task sees another one.
    one = one.select("label", "full", "rep", "copies", F.monotonically_increasing_id().alias("vid"), F.length("full").alias("dim"), *key)
    schema = "label string, full binary, rep long, copies long, vid long, dim int, k1 long, k2 long, code binary, scale float, error float"
    one = materialize(one.mapInArrow(_quantiser(kind), schema), "distinct-vectors")

    sizes = one.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # Stored, the aggregate meets its rows in a join that Spark can split at a hot label.
    sizes = materialize(sizes, "label-sizes")
    placed = one.select("label", "dim", "vid", "copies", "code", "scale", "error").join(sizes, ["label", "dim"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    tile = F.expr(
        "transform(sequence(0, blocks - 1), t -> named_struct("
        "'i', least(t, block), 'j', greatest(t, block), "
        "'side', CASE WHEN t = block THEN 1 WHEN block < t THEN 0 ELSE 2 END))"
    )
    tiles = ["label", "dim", "i", "j"]
    tiled = placed.select("label", "dim", "vid", "copies", "code", "scale", "error", F.explode(tile).alias("t"))
    tiled = tiled.select("label", "dim", "t.i", "t.j", "t.side", "vid", "copies", "code", "scale", "error")
    links = "vid long, links long, head long"
    coarse = materialize(tiled.groupBy(*tiles).applyInPandas(_coarse(threshold), f"{links}, open boolean, i int, j int, side int"), "tiles")
    again = coarse.where("open").select("vid", "i", "j", "side").join(one.drop("rep", "k1", "k2"), "vid")
    fine = materialize(again.groupBy(*tiles).applyInPandas(_fine(threshold, kind), links), "open-tiles")

    found = coarse.where("links > 0").select("vid", "links", "head").unionByName(fine)
    comp = connected_components(found.select(F.col("vid").alias("a"), F.col("head").alias("b")))
    total = found.groupBy("vid").agg(F.sum("links").alias("links"))
    placed = one.select("vid", "rep", "copies").join(total, "vid", "left").join(comp.withColumnRenamed("node", "vid"), "vid", "left")
    placed = placed.select("vid", "rep", F.coalesce("component", "vid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = materialize(placed, "placed")
    least = materialize(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    known = one.select("vid", *key).join(placed.join(least, "component").select("vid", "n_links", "component_id"), "vid").drop("vid")
    out = packed.select("vec_id", live.alias("live"), *key).join(known, key, "left")
    return out.select(
        "vec_id",
        F.when(F.col("live"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("live"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.coalesce(F.when(F.col("live"), F.col("component_id") == F.col("vec_id")), F.lit(True)).alias("kept"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, coalesce(low.c, e.vec_id) AS component_id,
       coalesce(low.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""
