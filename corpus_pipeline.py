"""A corpus from documents: clean, deduplicate, decontaminate, mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. All but the last return the columns of ``documents``; the last returns
what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table
from ridgeline.llm.decontaminate import decontaminate
from ridgeline.llm.lines import dedup_lines
from ridgeline.llm.minhash import keep_one
from ridgeline.llm.mixing import mix_sources
from ridgeline.llm.toxicity import reject_toxic, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return reject_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document of
    which nothing is left goes as well. ``n_chars`` follows the new text."""
    out = dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8) one row stays, that
    of the smallest id."""
    return keep_one(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs).drop("source")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
]

#: Classifiers, signatures and random draws have no SQL; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
