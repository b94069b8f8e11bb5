"""The queries of this subpackage, and DuckDB SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontaminate import op4_decontamination
from .embeddings import OP10_SQL, op10_embedding_near_dedup
from .lines import OP3_SQL, op3_line_dedup
from .minhash import op1_minhash_near_dedup
from .mixing import mix_targets, op6_pivotal_mixing
from .pii import op8_pii, pii_base_spans
from .secret_scan import BASE_RULES, RULES, op9_secret_scan
from .substring import op2_substring_dedup
from .toxicity import op5_toxicity
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_secret_scan": op9_secret_scan,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    # What SQL can express of op6 and op8.
    "mix_targets": mix_targets,
    "pii_base_spans": pii_base_spans,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op3_line_dedup": OP3_SQL,
    "op7_warc": oracles.OP7,
    "op9_secret_scan": oracles.secret_sql(RULES, len(BASE_RULES)),
    "op10_embedding_near_dedup": OP10_SQL,
    "mix_targets": oracles.MIX_TARGETS,
    "pii_base_spans": oracles.PII_BASE,
}
