"""Repeated lines by overlapping windows of three.

Lines are what lies between newlines. Every three consecutive lines of a
document are hashed together (128 bits); of equal windows in the corpus the
first stays, by document id and then by line, and every later one marks its
three lines. Marked lines are removed; the others are joined by newlines again.

Windows are judged on the input. Hashes are grouped with partial minima before
the shuffle, so a window that a third of all documents share is one row from
each task, and the join back to its many occurrences can be split.

Defined results: a null text has no lines and stays null; an empty one has one
empty line. Documents of fewer than three lines have no window and stay as
they are. Rows with a null id are neither judged nor counted. Rows that repeat
an id are distinct occurrences: of equal windows at the same line of the same
id all stay. Extra columns of the input are kept by ``dedup_lines``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, read_table, string_buffers

SPAN = 3


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(2))
            row, line, key = [], [], []

            def flush(batch=batch):
                # The lists of the rows so far; a very long text gives several batches.
                take = pa.array(row, pa.int64())
                k = np.frombuffer(b"".join(key), dtype=np.int64).reshape(-1, 2)
                return pa.record_batch(
                    [pa.array(k[:, 0]), pa.array(k[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32())],
                    names=["k1", "k2", "doc_id", "th", "line"],
                )

            for r in range(batch.num_rows):
                if not batch.column(2)[r].is_valid:
                    continue
                # A window is one stretch of the text, so no line is cut out of it.
                text = memoryview(raw[offsets[r] : offsets[r + 1]])
                ends = np.flatnonzero(raw[offsets[r] : offsets[r + 1]] == 10)
                starts = np.concatenate([[0], ends + 1])
                ends = np.append(ends, len(text))
                for i in range(len(starts) - span + 1):
                    row.append(r)
                    line.append(i)
                    key.append(hashlib.blake2b(text[starts[i] : ends[i + span - 1]], digest_size=16).digest())
                    if len(row) > 50_000:
                        yield flush()
                        row, line, key = [], [], []
            if row:
                yield flush()

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id, th, starts``: the first lines of each document's repeated windows.

    ``th`` is ``xxhash64`` of the text, which tells rows of one id apart.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    seen = materialize(src.mapInArrow(_windows(span), "k1 long, k2 long, doc_id long, th long, line int"), "line-windows")
    place = F.struct("doc_id", "line")
    first = seen.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Stored, the aggregate meets its rows in a join that Spark can split at hot keys.
    first = materialize(first.where("first < last").select("k1", "k2", "first"), "line-firsts")
    later = seen.join(first, ["k1", "k2"]).where(F.struct("doc_id", "line") > F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("starts"))


def _cutter(at: int, span: int):
    """Drop the marked lines of column ``at``; the last column has the starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(batch.num_columns - 1)
            text = batch.column(at)
            raw, offsets = string_buffers(text)
            n, removed, kept = [], [], []
            for r in range(batch.num_rows):
                if not text[r].is_valid:
                    n.append(0)
                    removed.append(0)
                    kept.append(None)
                    continue
                piece = raw[offsets[r] : offsets[r + 1]].tobytes()
                n.append(piece.count(b"\n") + 1)
                first = starts[r].values
                if first is None:
                    removed.append(0)
                    kept.append(piece)
                    continue
                step = np.zeros(n[-1] + span, dtype=np.int64)
                first = first.to_numpy(zero_copy_only=False)
                step[first] += 1
                step[first + span] -= 1
                gone = np.cumsum(step)[: n[-1]] > 0
                removed.append(int(gone.sum()))
                kept.append(b"\n".join(x for x, g in zip(piece.split(b"\n"), gone, strict=True) if not g))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                names=[f"c{i}" for i in range(len(cols))] + ["n_lines", "n_removed"],
            )

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` with shorter texts; last come ``n_lines`` and ``n_removed``,
    whatever columns of these names the input has."""
    found = materialize(repeated_windows(docs, id_col, text_col, span), "line-starts")
    found = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("starts").alias("__starts"))
    # Columns go by place from here on, so no name can clash.
    names = docs.columns
    at, key = names.index(text_col), names.index(id_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    types = [f.dataType for f in rows.schema.fields]
    rows = rows.withColumn("__id", F.col(f"c{key}").cast("long")).withColumn("__th", F.xxhash64(f"c{at}"))
    # The narrow side builds, so no text is sorted.
    rows = rows.join(found.hint("shuffle_hash"), ["__id", "__th"], "left").drop("__id", "__th")
    schema = StructType([StructField(f"c{i}", t) for i, t in enumerate(types)])
    schema = schema.add("n_lines", LongType()).add("n_removed", LongType())
    return rows.mapInArrow(_cutter(at, span), schema).toDF(*names, "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Line pieces of every document with the windows that start at them.
_SQL_LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
),
win AS (
  SELECT doc_id, i,
         CASE WHEN lead(i, 2) OVER w IS NOT NULL
              THEN line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w END AS k
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win WHERE k IS NOT NULL
  ) WHERE nth > 1
),
marked AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (SELECT unnest([0, 1, 2]) AS d))
"""

OP3_SQL = f"""
WITH {_SQL_LINES}
SELECT d.doc_id, count(l.i) AS n_lines, count(m.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN m.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id
LEFT JOIN marked m ON m.doc_id = l.doc_id AND m.i = l.i
GROUP BY d.doc_id
"""
