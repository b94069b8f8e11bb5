"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. Equal
contents are one blob, scanned once for each version of the rules. The ledger
keeps a row for each (blob, rule version) pair that was scanned, findings or
not, so a later run scans only pairs that it lacks, and findings are joined
back to all paths that ever held the blob. Everything runs as DataFrame
expressions in the JVM.

Versions are stored once with a number each; the least number of a blob is its
head, the one row that is scanned, however many rows repeat it.

Matches with their positions come from splitting: a text is marked around each
match of a rule with U+0001 and cut at the marks. Each piece becomes a narrow
row, and running sums of the lengths give positions, so the cost grows with the
matches and not with their square. U+0001 in the text is first replaced by
U+0002; no rule matches either. Positions are code points, ends exclusive.

Defined results: null and empty contents are blobs without findings. Repeated
rows are repeated in the result. Rows with a null path keep a null path. Other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those whose ``group`` is shorter than
    ``least`` characters are dropped. Every text with a match holds one of
    ``hints``, or with ``fold`` its lower case does, and matches ``sieve``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    fold: bool = False
    sieve: str = ""


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
        ("passw", "secret", "token", "apikey", "api_key"),
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    # A match takes its whole run, so the length can be part of the pattern.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, (), False, r"[0-9a-f]{32}"),
)

#: Formats beyond the base rules, all published by their issuers.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, (".eyJ",)),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,128}@", 0, 1, ("://",)),
)

RULES = BASE_RULES + EXTRA_RULES
RULE_VERSION = "2"


FOUND = "array<struct<start:int,ord:int,kind:string,stop:int>>"


def _may_match(text: Column, low: Column, rule: Rule) -> Column:
    out = F.lit(not rule.hints)
    for h in rule.hints:
        out = out | F.contains(low if rule.fold else text, F.lit(h))
    return out & text.rlike(rule.sieve) if rule.sieve else out


def _pieces(text: Column, low: Column, rule: Rule) -> Column:
    """Lengths of the pieces of a text between and in the matches of a rule, of
    the latter also that of the group; null if nothing can match."""
    pieces = F.split(F.regexp_replace(text, f"({rule.pattern})", "\u0001$1\u0001"), "\u0001", -1)
    group = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    # Matches stand at the odd places of the pieces.
    sizes = F.transform(
        pieces, lambda x, i: F.struct(F.length(x).alias("n"), F.when((i % 2) == 1, group(x)).otherwise(F.lit(-1)).alias("g"))
    )
    return F.when(_may_match(text, low, rule), sizes)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` of the blobs with findings, from distinct ``blob,
    content``; spans by start, then in the order of the rules."""
    safe = blobs.select("blob", F.translate("content", "\u0001", "\u0002").alias("text")).withColumn("low", F.lower("text"))
    # A text without a match of a rule is one piece, which says nothing.
    sizes = [_pieces(F.col("text"), F.col("low"), r) for r in rules]
    cut = safe.select("blob", F.posexplode(F.array(*sizes)).alias("ord", "pieces")).where("size(pieces) > 1")
    piece = cut.select("blob", "ord", F.posexplode("pieces").alias("at", "p")).select("blob", "ord", "at", "p.n", "p.g")
    order = Window.partitionBy("blob", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = piece.withColumn("stop", F.sum("n").over(order).cast("int"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("ord") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("ord") + 1)
    span = F.struct((F.col("stop") - F.col("n")).alias("start"), "ord", kind.alias("kind"), "stop")
    # Grouped by the window's own keys first, so that a blob's spans meet as a few arrays.
    by_rule = piece.where(F.col("g") >= least).groupBy("blob", "ord").agg(F.collect_list(span).alias("s"))
    return by_rule.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None before the first run."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return None
    return spark.read.schema(LEDGER).parquet(path)


LEDGER = f"blob string, rules string, spans {FOUND}"


def scan(
    versions: DataFrame,
    ledger_path: str,
    path_col: str = "path",
    content_col: str = "content",
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """``path, blob, spans`` for every version, scanning only what is new.

    Scanned blobs are appended to the Parquet table at ``ledger_path``, with
    Spark's commit protocol. If a run dies before its commit, the next one
    scans the same blobs again.
    """
    spark = versions.sparkSession
    src = versions.select(
        F.col(path_col).alias("path"), F.coalesce(F.col(content_col).cast("string"), F.lit("")).alias("content")
    )
    src = src.select("path", blob_id(F.col("content")).alias("blob"), F.monotonically_increasing_id().alias("number"), "content")
    # Stored with their numbers, versions have the same ones whenever they are read.
    src = materialize(src, "secret-versions")
    heads = src.groupBy("blob").agg(F.min("number").alias("number"))
    ledger = read_ledger(spark, ledger_path)
    if ledger is not None:
        heads = heads.join(ledger.where(F.col("rules") == rule_version).select("blob"), "blob", "left_anti")
    # A number is one row's, so contents are dealt evenly; the narrow side builds.
    heads = materialize(heads.select("number"), "secret-heads")
    unseen = src.select("number", "blob", "content").join(heads.hint("shuffle_hash"), "number", "left_semi")
    found = materialize(find_spans(unseen.select("blob", "content"), rules), "secret-found")
    none = F.array().cast(FOUND)
    blobs = src.select("number", "blob").join(heads, "number", "left_semi").join(found, "blob", "left")
    scanned = blobs.select("blob", F.lit(rule_version).alias("rules"), F.coalesce("spans", none).alias("spans"))
    scanned.write.mode("append").option("compression", "zstd").parquet(ledger_path)
    # Runs side by side may both have scanned a blob.
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rules") == rule_version)
    # Stored, the aggregate meets the paths in a join that Spark can split at a hot blob.
    known = materialize(known.where("size(spans) > 0").groupBy("blob").agg(F.first("spans").alias("spans")), "secret-known")
    return src.select("path", "blob").join(known, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is the session's ``spark.ridgeline.ledger``, which later runs
    go on from; where that is unset, a new one, so every blob is scanned."""
    docs = read_table(spark, sf_dir, "documents")
    ledger = spark.conf.get("spark.ridgeline.ledger", None) or scratch_path(spark, "secret-ledger")
    found = scan(docs, ledger, "doc_id", "text")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
