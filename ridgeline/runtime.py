"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine, as in tests, gets a temporary
    folder, which is remembered; a cluster is an error, as its executors share
    no local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.ridgeline.scratch", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.ridgeline.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of this application."""
    return f"{scratch_dir(spark)}/ridgeline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once no result
    that was not stored yet depends on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/ridgeline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store_uri(spark: SparkSession, folder: str) -> str:
    """The folder's full URI: a path alone is on the cluster's default store,
    which ``pyarrow.fs`` would take for the local disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


#: Rows of a large table, about, that one shuffle partition holds.
ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of so many counted ``rows``, dealt by ``keys`` over partitions of
    about ``ROWS`` each; as it is where the session's own number is enough.

    A fetched block, a sort and what it spills then keep their size however many
    rows there are and however few partitions the session asks for.
    """
    n = math.ceil(rows / ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
