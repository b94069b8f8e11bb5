"""Incremental load."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def removals(staged: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are staged and no longer landed."""
    return staged.select(keys).join(landed.select(keys), keys, "left_anti").distinct()


def changes(landed: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Landed rows that are new, or newer than what is staged.

    New is told by the key's absence, so a row without a timestamp is taken
    once and not again and again.
    """
    known = staged.select(*keys, F.col("timestamp").alias("__ts"), F.lit(True).alias("__known"))
    both = landed.join(known, keys, "left")
    return both.where(F.col("__known").isNull() | (F.col("timestamp") > F.col("__ts"))).drop("__ts", "__known")


def spatial_chunk(pending: DataFrame, keys: list[str], rows: int = 100_000, cell: int = 5000, e: str = "easting", n: str = "northing") -> DataFrame:
    """The first rows by cell; the keys settle ties, so the chunk is the same
    whenever it is computed."""
    place = [F.floor(F.col(e) / cell), F.floor(F.col(n) / cell)]
    return pending.orderBy(*place, *keys).limit(rows)


def upsert(staged: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updated rows in place of those with the same key, new ones beside them."""
    return staged.join(updates.select(keys), keys, "left_anti").select(staged.columns).unionByName(updates.select(staged.columns))


def delete(staged: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return staged.join(gone.select(keys), keys, "left_anti").select(staged.columns)


def clear_without_elevation(staged: DataFrame) -> DataFrame:
    """What could not be tagged is dropped, to be tried again on new tiles."""
    return staged.where("elevation IS NOT NULL")


def refresh(staged: DataFrame, landed: DataFrame, keys: list[str], tag, retag: bool = False) -> DataFrame:
    """One whole incremental load: ``tag`` completes the changed rows.

    Removals apply whether or not anything changed. There is no loop over
    chunks: one pass spills where a chunk would have been cut.
    """
    if retag:
        staged = clear_without_elevation(staged)
    updates = tag(changes(landed, staged, keys)).select(staged.columns)
    gone = removals(staged, landed, keys)
    return upsert(delete(staged, gone, keys), updates, keys)


class ConcurrentWrite(RuntimeError):
    """Someone else stored the next version first; read it and try again."""


#: Name of the folders that hold a partition's files.
_PART = "__part"


class SnapshotTable:
    """A table in versions, each a list of partitions and where their files are.

    A version is stored by writing files into a folder of its own and then a
    list ``v=N.json``, under another name first and renamed where nothing is
    yet. So a reader never sees a version half written, a writer never
    overwrites what it or a reader reads, and of two writers that begin with one
    version the second fails instead of losing the first one's rows. What a
    writer that died has left behind goes with ``vacuum``.

    ``part`` says by an expression over a row in which partition it lies: a
    change rewrites the partitions that it touches and lists the others as they
    are. Without it there is one. Paths go through Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, part: Column | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.part = F.lit("all") if part is None else F.coalesce(part.cast("string"), F.lit("none"))

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        fs, p = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self._names() if n.startswith("v=") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def partitions(self, version: int | None = None) -> dict[str, str]:
        """The folder of every partition of the current or a given version."""
        known = self.versions()
        if version is None and not known:
            return {}
        version = known[-1] if version is None else version
        if version not in known:
            raise FileNotFoundError(f"{self.path}: no version {version}")
        return json.loads(self.spark.read.text(f"{self.path}/v={version}.json", wholetext=True).first().value)

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The current or a given version; empty before the first write."""
        return self._read(self.partitions(version).values())

    def _store(self, df: DataFrame, files: int | None) -> dict[str, str]:
        """Write rows; the folder of each partition that has any."""
        folder = f"data-{uuid.uuid4().hex}"
        placed = df.select([F.col(c) for c in self.schema.names]).withColumn(_PART, self.part)
        # Rebalancing splits a hot partition and joins small ones, file by file.
        placed = placed.hint("rebalance", F.col(_PART)) if files is None else placed.coalesce(files)
        placed.write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        return {n: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_PART}=")}

    def _commit(self, parts: dict[str, str], base: int) -> int:
        version, jvm = base + 1, self.spark._jvm
        fs, tmp = self._fs(), self._path(f"_new-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(self._path(f"v={version}.json")), options)
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConcurrentWrite(f"{self.path}: version {version} was written by someone else") from None
            raise
        return version

    def _base(self, base: int | None) -> int:
        return max(self.versions(), default=0) if base is None else base

    def write(self, df: DataFrame, files: int | None = None, base: int | None = None) -> int:
        """A new version of these rows alone, in at most ``files`` files a
        partition if given (compaction). ``base`` is the version that the rows
        were made from, by default the current one."""
        base = self._base(base)
        return self._commit(self._store(df, files), base)

    def change(self, keys: list[str], updates: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> int:
        """A new version with the rows of ``updates`` in place of those with
        their keys, and without the keys of ``gone``. Only partitions that held
        such a key, or get one, are read whole and written."""
        base = self._base(base)
        parts = self.partitions(base) if base else {}
        updates = updates.select(self.schema.names)
        affected = updates.select(keys) if gone is None else updates.select(keys).unionByName(gone.select(keys))
        # Of the whole table only the keys and what tells the partition are read.
        held = self._read(parts.values()).withColumn(_PART, self.part).join(affected, keys, "left_semi").select(_PART)
        into = updates.withColumn(_PART, self.part).select(_PART)
        touched = {f"{_PART}={_escaped(self.spark, r[0])}" for r in held.unionByName(into).distinct().collect()}  # a row a partition
        if not touched:
            return base
        old = self._read(f for n, f in parts.items() if n in touched)
        new = old.join(affected, keys, "left_anti").select(self.schema.names).unionByName(updates)
        kept = {n: f for n, f in parts.items() if n not in touched}
        return self._commit({**kept, **self._store(new, None)}, base)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and files that none lists.
        No write may be under way."""
        fs, known = self._fs(), self.versions()
        for v in known[:-keep]:
            fs.delete(self._path(f"v={v}.json"), False)
        used = {f for v in known[-keep:] for f in self.partitions(v).values()}
        for folder in self._names():
            if folder.startswith("_new-"):
                fs.delete(self._path(folder), True)
            elif folder.startswith("data-"):
                parts = [f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_PART}=")]
                for f in parts if used & set(parts) else [folder]:
                    if f not in used:
                        fs.delete(self._path(f), True)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as Spark writes it into a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
