"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``f`` times its size takes ``floor(f)`` copies of each
of its documents, and one more of some: each has the fractional part of ``f``
as the probability of a further copy. Pivotal rounding pairs two undecided
documents and moves probability from one to the other, by a random draw that
keeps both expectations, until one of them is 0 or 1; the other goes on to the
next pair. So the number taken is fixed but for one last document.

Documents of a source are spread over blocks by a hash, and paired in the order
of their sizes, which keeps the taken words close to the target. Each block
leaves one undecided document; these are combined over a tree of blocks of
blocks until one is left for each source. Blocks and draws come from the seed
and a hash of the row and of its ordinal among rows that are equal to it, so
reruns agree however the rows are partitioned, and equal rows are spread too.

The ordinal is counted in two steps, so that many equal rows are never numbered
by one task: rows are numbered within the partitions of a stored table, and the
partitions' counts, a row for each key and partition, are summed before.

Defined results: a null text has size 0. A null source is a source of its own,
the last. Repeated rows are decided one by one. If all sizes are 0 nothing is
taken. Null ids are allowed. Rows equal in id, source and text are drawn for
one by one. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, materialize, mix, read_table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Expected rows of a first-level block, and blocks that meet in one of the next.
BLOCK_ROWS = 2_000
FAN_IN = 64

WORDS = r"[^\x20\x09-\x0D]+"


def _in_order(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the ``place`` of each source in the order of the names,
    null last: sorted by ranges, and numbered within them from the stored
    table's numbers and the counts of the ranges before."""
    by_name = F.col("source").asc_nulls_last()
    s = sizes.repartitionByRange(by_name).sortWithinPartitions(by_name)
    s = materialize(s.withColumn("number", F.monotonically_increasing_id()), "source-order")
    part = F.shiftright("number", 33)
    counts = s.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("number").alias("low"))
    # A row a range, of which there are as many as shuffle partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "low", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return s.withColumn("part", part).join(starts, "part").withColumn("place", F.col("number") - F.col("low") + F.col("before")).drop("number", "part", "low", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """``source, source_size, rows, target`` from ``source, source_size, rows``.

    Sources weigh ``weights`` in turn, in the order of their names by code
    point, null last, and share the sum of all sizes. A target above
    ``max_copies`` times its source's size stops there, and the excess is
    shared again by weight, until none is above. One row a source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(_in_order(sizes).withColumn("weight", weight).drop("place"), "sources")
    top = F.col("source_size") * F.lit(float(max_copies))
    total = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    share, full = 0.0, -1
    while True:
        # Below the present share a source is full; the others share the rest.
        is_full = F.col("weight") * F.lit(share) > top
        a = s.agg(
            F.sum(F.when(is_full, 1).otherwise(0)).alias("n"),
            F.coalesce(F.sum(F.when(is_full, top)), F.lit(0.0)).alias("mass"),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if (a.n or 0) == full or not a.open:
            break
        full = a.n or 0
        share = (total - a.mass) / a.open
    target = F.when(F.col("weight") * F.lit(share) > top, top).otherwise(F.col("weight") * F.lit(share))
    return s.select("source", "source_size", "rows", target.alias("target"))


def _uniform(a: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(a.view(np.uint64) ^ mix(np.array([seed], dtype=np.uint64))) >> U64(11)) / float(1 << 53)


def _pivot(seed: int):
    """Round the rows of one block; a last undecided one keeps its probability."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], kind="stable", ignore_index=True)
        p = pdf["p"].to_numpy().copy()
        draw = _uniform(pdf["key"].to_numpy(), seed)
        held = -1
        for j in range(len(p)):
            if p[j] <= 0.0 or p[j] >= 1.0:
                continue
            if held < 0:
                held = j
                continue
            a, b = p[held], p[j]
            both = a + b
            if both < 1.0:
                if draw[j] * both < b:
                    p[held], p[j], held = 0.0, both, j
                else:
                    p[held], p[j] = both, 0.0
            else:
                left = both - 1.0
                if draw[j] * (2.0 - both) < 1.0 - b:
                    p[held], p[j], held = 1.0, left, j
                else:
                    p[held], p[j] = left, 1.0
                if p[held] <= 1e-12:
                    p[held] = 0.0
                    held = -1
        pdf["p"] = p
        return pdf

    return run


def _spread_equal(sized: DataFrame) -> DataFrame:
    """``sized`` without ``number``, with a key of its own for each of equal rows.

    Equal rows are told apart only by their ordinals, so it does not matter
    which of them gets which.
    """
    part = F.shiftright("number", 33)  # the partition of the stored table
    counts = sized.groupBy("key", part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("key"))})
    repeated = materialize(counts.where("all > 1").select("key", "part", "before"), "repeated")
    placed = sized.withColumn("part", part).join(repeated, ["key", "part"])
    ordinal = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("number")) - 1
    placed = placed.withColumn("ordinal", ordinal)
    placed = placed.withColumn("key", F.when(F.col("ordinal") > 0, F.xxhash64("key", "ordinal")).otherwise(F.col("key")))
    single = sized.join(repeated.select("key").distinct(), "key", "left_anti")
    names = [c for c in sized.columns if c != "number"]
    return single.select(names).unionByName(placed.select(names))


_ROW = "doc_id long, size long, sid long, source_size long, target double, whole long, p double, key long, block long"


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: float = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row.

    ``taken`` is the number of words that the mix takes of a document: its size
    times its copies, of which there are at most ``max_copies``.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed)).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialize(
        source_targets(sizes, weights, max_copies).withColumn("sid", F.xxhash64("source", F.lit(1))), "targets"
    )
    # Null sources are one source: join on the name with a flag for null.
    named = targets.select(
        F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "target", "rows", "sid"
    )
    rows = _spread_equal(sized).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A hair below an integer is that integer.
    rows = rows.join(named, ["name", "none"]).withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + 1e-12))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")))
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.col("key"), blocks).cast("long"))

    most = targets.agg(F.max("rows")).first()[0] or 0
    level, n = rows.select([c.split()[0] for c in _ROW.split(", ")]), -(-most // BLOCK_ROWS)
    decided, depth = [], 0
    while True:
        out = materialize(level.groupBy("sid", "block").applyInPandas(_pivot(seed + depth), _ROW), "pivot")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        if n <= 1:
            # One document of a source is left: it goes by its own draw.
            draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            decided.append(out.withColumn("p", F.when(undecided, (draw < F.col("p")).cast("double")).otherwise(F.col("p"))))
            break
        decided.append(out.where(~undecided))
        level = out.where(undecided).withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)).cast("long"))
        n, depth = -(-n // FAN_IN), depth + 1
    done = reduce(DataFrame.unionByName, decided)
    source = targets.select("sid", "source")
    return done.join(source, "sid").select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.round("p").cast("long"))).alias("taken"),
    )


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("source")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets alone: ``source, source_size, target``, a row a source."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")).alias("source_size"), F.count("*").alias("rows")
    )
    return source_targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))
