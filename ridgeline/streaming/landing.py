"""The incremental load as a stream: new landing files update a staged table.

Landing files are read as a file stream; each micro-batch is one change, by the
same operators as the batch load, into the next version of the staged table. A
batch costs the partitions that its rows lie in, and old versions go as new ones
come. Removals need the whole landing state, so they are left to batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators.incremental import SnapshotTable, changes
from ridgeline.runtime import materialize

#: Versions that readers of the staged table may still be reading.
KEEP = 3


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the latest by timestamp, ties by the other columns."""
    rest = [c for c, t in rows.dtypes if c not in (*keys, "timestamp") and not t.startswith("map")]
    order = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc_nulls_last(), *rest)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert_batch(table: SnapshotTable, keys: list[str], tag: Callable[[DataFrame], DataFrame]):
    """A function for ``foreachBatch``. A batch that is run again finds its rows
    staged already and changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        base = max(table.versions(), default=0)
        staged = table.read()
        updates = materialize(tag(changes(newest(batch, keys), staged, keys)).select(staged.columns), "batch")
        if not updates.isEmpty():
            table.change(keys, updates, base=base)
            table.vacuum(KEEP)

    return run


def stage_stream(
    spark: SparkSession, folder: str, table: SnapshotTable, keys: list[str], checkpoint: str, schema, tag: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> StreamingQuery:
    """Start the stream over ``folder``; it ends when all files are taken."""
    landed = spark.readStream.schema(schema).parquet(folder)
    writer = landed.writeStream.foreachBatch(upsert_batch(table, keys, tag))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
