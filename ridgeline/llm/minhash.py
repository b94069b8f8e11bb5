"""Near-duplicate documents by SuperMinHash signatures.

Every document becomes a set of word shingles. SuperMinHash gives each element
one random permutation of the signature's components and a random value on
every rank of it; a component keeps the least ``rank + value`` that reached it.
Work goes rank by rank and stops at a document once its components are all
filled, for later ranks are larger. Documents that agree on all components of
a band share a bucket.

Candidates are confirmed on the full sets in two rounds. The first compares
each member of a bucket with one leader. Components of these links settle most
buckets. In those that still hold several components, the second compares all
members of different components, in tiles of bounded size, by their signatures
and then on the full sets, until the tile's components are joined. So a linked
group costs one comparison a member and no link that joins components is lost
(but with the probability that banding misses it, below 1e-6 a pair).

Defined results: a document without words (null, empty, blanks) has an empty
set and no links; one with fewer words than a shingle has its whole sequence as
the one shingle. Rows with equal sets are linked. Repeated rows keep their own
row in the result. A null id stays null and takes no part in any group; its row
is kept. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    _GOLDEN,
    U64,
    chunks,
    connected_components,
    materialize,
    mix,
    read_table,
    shingle_hashes,
)

#: Members of a bucket that one side of a tile holds.
TILE = 256
_LEVEL = U64(1 << 48)


def bands_for(percent: int, components: int = 128, miss: float = 1e-6) -> tuple[int, int]:
    """Rows a band and bands, the widest band that misses a pair at the
    threshold with a probability below ``miss``."""
    s = percent / 100
    for rows in range(16, 0, -1):
        bands = components // rows
        if (1 - s**rows) ** bands <= miss:
            return rows, bands
    return 1, components


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` values for each set; an empty set keeps the largest."""
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = sig.reshape(-1)
    live = [i for i, s in enumerate(sets) if len(s)]
    if not live:
        return sig
    item = np.concatenate([sets[i] for i in live])
    owner = np.repeat(np.array(live), [len(sets[i]) for i in live])
    perm: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for j in range(m):
            x = mix(item + U64(j + 1) * _GOLDEN)
            value = (x >> U64(16)) + U64(j) * _LEVEL
            k = j + (((x & U64(0xFFFF)) * U64(m - j)) >> U64(16)).astype(np.int64)
            if perm is None:
                at = k
            else:
                row = np.arange(len(item))
                at = perm[row, k].astype(np.int64)
                perm[row, k] = perm[row, j]
            np.minimum.at(flat, owner * m + at, value)
            if j + 1 == m:
                break
            full = (sig[live] < U64(j + 1) * _LEVEL).all(axis=1)
            if full.any():
                live = [i for i, done in zip(live, full, strict=True) if not done]
                if not live:
                    break
                open_ = np.zeros(len(sets), dtype=bool)
                open_[live] = True
                stay = open_[owner]
                item, owner, k = item[stay], owner[stay], k[stay]
                if perm is not None:
                    perm = perm[stay]
            if perm is None:
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(item), m)).copy()
                row = np.arange(len(item))
                perm[row, k] = 0
    return sig


def band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
        for i in range(rows):
            acc = mix(acc * U64(0xD6E8FEB86659FD93) + sig[:, i : rows * bands : rows])
        return acc


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s).sum(dtype=np.uint64) + U64(len(s)) * _GOLDEN for s in sets], dtype=np.uint64))


def _signer(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1), lower=True, limit=1 << 19):
                sets = shingle_hashes(chunk.hashes, chunk.first, k)
                sig = superminhash(sets, rows * bands)
                keys = band_hashes(sig, rows, bands).view(np.int64)
                keys = [x if len(s) else None for x, s in zip(keys, sets, strict=True)]
                yield pa.record_batch(
                    [
                        ids.slice(chunk.rows.start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(set_keys(sets).view(np.int64)),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "fp", "bands"],
                )

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True, limit=1 << 19):
                sets = shingle_hashes(chunk.hashes, chunk.first, k)
                yield pa.record_batch(
                    [
                        pa.array(set_keys(sets).view(np.int64)),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["fp", "items"],
                )

    return run


def _resigner(m: int):
    """Signatures of stored sets, once for each set however many tiles it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [np.sort(x.values.to_numpy().view(np.uint64)) for x in part.column(1)]
                sig = [s.tobytes() for s in superminhash(sets, m)]
                yield pa.record_batch([*part.columns, pa.array(sig, pa.binary())], names=["fp", "items", "sig"])

    return run


def _tiler(rows: int, bands: int, percent: int):
    """Links between the components of a tile, enough to join those that meet.

    A pair is looked at in the first band that its documents share only, by
    signature first and then on the full sets, and not at all once other links
    have joined its components. So a tile emits fewer links than it has rows.
    """
    s = percent / 100
    m = rows * bands
    least = s - 5 * (s * (1 - s) / m) ** 0.5

    def run(pdf):
        import pandas as pd

        band = pdf["band"].iloc[0]
        pdf = pdf.sort_values("side", kind="stable", ignore_index=True)
        side = pdf["side"].to_numpy()
        fp, comp = pdf["fp"].to_numpy(), pdf["component"].to_numpy().copy()
        sets = [np.sort(np.asarray(x).view(np.uint64)) for x in pdf["items"]]
        size = np.array([len(x) for x in sets])
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint64).reshape(len(pdf), m)
        keys = band_hashes(sig, rows, bands).view(np.int64)
        n_left = int((side < 2).sum())
        right = int((side == 0).sum())  # rows of the second side start here
        links = []
        for i in range(n_left):
            at = np.arange(max(right, i + 1), len(fp))
            at = at[comp[at] != comp[i]]
            at = at[100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i])]
            if not len(at):
                continue
            at = at[(sig[at] == sig[i]).mean(axis=1) >= least]
            shared = keys[at] == keys[i]
            at = at[keys[i][shared.argmax(axis=1)] == band]
            for j in at:
                if comp[j] == comp[i]:
                    continue
                x, y = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((fp[i], fp[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("fp").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("n"))
        .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n") - F.col("i")))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    components: int = 128,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Links rows with ``100 * |A & B| >= percent * |A | B|`` of their sets of
    distinct lower-cased ``shingle``-word shingles.
    """
    rows, bands = bands_for(percent, components)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        src.mapInArrow(_signer(shingle, rows, bands), "doc_id long, n_shingles long, fp long, bands array<long>"),
        "minhash",
    )
    live = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    keyed = live.select("fp", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("fp").alias("leader"), F.max("fp").alias("last")).where("leader <> last")
    # Stored, the aggregate meets its rows in a join that Spark can split at hot keys.
    buckets = materialize(buckets.select("band", "leader"), "leaders")
    members = materialize(keyed.join(buckets, "band").distinct(), "buckets")

    involved = members.select("fp").distinct()
    owners = live.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(involved, "fp", "left_semi")
    texts = src.join(owners.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_setter(shingle), "fp long, items array<long>")
    sets = materialize(sets.join(involved, "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    pairs = members.where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct()
    links = materialize(_confirm(pairs, sets, percent), "links")
    comp = connected_components(links)

    # Buckets whose members are still in different components.
    placed = members.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "band", "fp", F.coalesce("component", "fp").alias("component")
    )
    placed = materialize(placed, "placed")
    torn = (
        placed.groupBy("band")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        # A bucket of two holds just the pair that was compared.
        .where("lo <> hi AND size > 2")
        .select("band", "size")
    )
    rest = materialize(placed.join(materialize(torn, "torn-bands"), "band"), "torn")
    if not rest.isEmpty():
        links = links.unionByName(materialize(_cross_links(rest, sets, rows, bands, percent), "links"))
        comp = connected_components(links)

    heads = live.groupBy("fp").agg(F.min("doc_id").alias("least"))
    heads = heads.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    heads = materialize(heads, "heads")
    lowest = materialize(heads.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    grouped = heads.join(lowest, "component").select("fp", "component_id")
    out = signed.select("doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL AND n_shingles > 0 THEN fp END").alias("fp"))
    return out.join(grouped, "fp", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _cross_links(rest: DataFrame, sets: DataFrame, rows: int, bands: int, percent: int) -> DataFrame:
    """Links between members of one bucket in different components, by tiles.

    A member goes to one tile for each block of its bucket, so what is copied
    is the bucket's rows times its blocks, and pairs stay inside the tile.
    """
    n = F.ceil(F.col("size") / F.lit(TILE))
    block = F.pmod(F.xxhash64("fp"), n)
    placed = rest.withColumn("blocks", n.cast("int")).withColumn("block", block.cast("int"))
    tiled = placed.select(
        "band",
        "fp",
        "component",
        F.explode(
            F.expr(
                "transform(sequence(0, blocks - 1), t -> named_struct("
                "'i', least(t, block), 'j', greatest(t, block), "
                "'side', CASE WHEN t = block THEN 1 WHEN block < t THEN 0 ELSE 2 END))"
            )
        ).alias("tile"),
    ).select("band", "fp", "component", "tile.i", "tile.j", "tile.side")
    torn = sets.join(rest.select("fp").distinct(), "fp", "left_semi").mapInArrow(_resigner(rows * bands), "fp long, items array<long>, sig binary")
    tiled = tiled.join(materialize(torn, "signed-sets"), "fp")
    return tiled.groupBy("band", "i", "j").applyInPandas(_tiler(rows, bands, percent), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the
    smallest id (null last); of rows that repeat it, any one.

    Rows are told apart by a number, not by their id: several texts under one
    id are several rows, each judged by its own text. Rows without words stay.
    """
    # Columns go by place, so no name can clash; stored, rows keep their numbers.
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered-rows")
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    groups = near_duplicates(rows, "__row", text, shingle, percent).select(F.col("doc_id").alias("__row"), "component_id")
    placed = rows.select("__row", F.col(key).alias("id")).join(groups, "__row")
    # A null id sorts after every other one.
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first")).select("first.__row")
    kept = rows.join(first.hint("shuffle_hash"), "__row", "left_semi").drop("__row")
    return kept.toDF(*names)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)
