"""Text for a relational serving database (S24-S26): tables partitioned by
``ptn``, one partition for each square degree, and the statements that load
exported files. Nothing here connects anywhere; the statements are rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ridgeline.functions.geo import degree_part
from ridgeline.functions.profile import array_literal
from ridgeline.schema import layer_schema

SCHEMA = "routing"
TABLES = ("nodes", "edges")
#: Keys, and the columns that windows and filters ask for, of each table.
KEYS = {"nodes": ("id", "ptn"), "edges": ("src", "dst", "ptn")}
INDEXES = {"nodes": (("lat", "lon"),), "edges": (("src_lat", "src_lon"), ("highway",), ("surface",))}
#: Whole degrees, both ends included, of the squares over the islands.
LATITUDES, LONGITUDES = (48, 60), (-15, 1)

_TYPES = {"bigint": "bigint", "double": "float", "string": "text", "int": "integer", "boolean": "boolean"}


def _type(kind) -> str:
    return f"{_type(kind.elementType)} ARRAY" if isinstance(kind, ArrayType) else _TYPES[kind.simpleString()]


def table_ddl(table: str, schema: StructType | None = None) -> list[str]:
    """Statements that make a table anew, partitioned by ``ptn``, with indexes."""
    schema = schema or layer_schema("optimised", table)
    columns = ", ".join(f"{f.name} {_type(f.dataType)}" + (" NOT NULL" if f.name == "ptn" else "") for f in schema.fields)
    name = f"{SCHEMA}.{table}"
    made = f"CREATE TABLE {name} ({columns}, PRIMARY KEY ({', '.join(KEYS[table])})) PARTITION BY LIST (ptn)"
    indexes = [f"CREATE INDEX {table}_{'_'.join(c)}_inx ON {name} ({', '.join(c)})" for c in INDEXES[table]]
    return [f"CREATE SCHEMA IF NOT EXISTS {SCHEMA}", f"DROP TABLE IF EXISTS {name}", made, *indexes]


def partition_ddl(
    spark: SparkSession, tables: Iterable[str] = TABLES, latitudes: tuple[int, int] = LATITUDES, longitudes: tuple[int, int] = LONGITUDES
) -> DataFrame:
    """``name, ptn, statement``: one partition a table and square."""
    squares = spark.range(latitudes[0], latitudes[1] + 1).select(F.col("id").alias("lat"))
    squares = squares.select("lat", F.explode(F.sequence(F.lit(longitudes[0]), F.lit(longitudes[1]))).alias("lon"))
    squares = squares.select(F.expr(f"concat({degree_part('lat')}, '_', {degree_part('lon')})").alias("ptn"))
    named = squares.select(F.explode(F.array(*[F.lit(t) for t in tables])).alias("name"), "ptn")
    table = F.concat(F.lit(f"{SCHEMA}."), F.col("name"))
    made = F.concat(F.lit("CREATE TABLE "), table, F.lit("_"), F.col("ptn"), F.lit(" PARTITION OF "), table)
    return named.withColumn("statement", F.concat(made, F.lit(" FOR VALUES IN ('"), F.col("ptn"), F.lit("')")))


def copy_statement(table: str, schema: StructType | None = None) -> str:
    schema = schema or layer_schema("optimised", table)
    return f"COPY {SCHEMA}.{table} ({', '.join(schema.names)}) FROM STDIN"


def text_rows(df: DataFrame, table: str) -> DataFrame:
    """The optimised columns in their order, arrays as literals, for ``files.export_tsv``."""
    schema = layer_schema("optimised", table)

    def cell(f) -> Column:
        c = F.col(f.name).cast(f.dataType)
        return array_literal(c).alias(f.name) if isinstance(f.dataType, ArrayType) else c.alias(f.name)

    return df.select([cell(f) for f in schema.fields])


def load_scripts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``path, statement`` for every data file of an export (S26): each file is
    the input of one statement, so files load side by side and again alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))] if fs.exists(path) else []
    rows = spark.createDataFrame([(str(p),) for p in sorted(found, key=str)], "path string")
    return rows.withColumn("statement", F.lit(copy_statement(table)))
