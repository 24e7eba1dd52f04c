"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.byte_bpe import op7_byte_bpe
from driftline.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from driftline.llm.license_scan import op10_license_scan
from driftline.llm.mixing import op1_mixing
from driftline.llm.quality_model import op9_quality_model
from driftline.llm.quality_rules import OP4_SQL, op4_quality_rules
from driftline.llm.simhash import op6_simhash
from driftline.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from driftline.llm.token_count import op2_token_counts
from driftline.llm.url_filter import op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_token_counts, op3_url_filter, op4_quality_rules, op5_exact_dedup, op6_simhash, op7_byte_bpe, op8_substring_dedup, op9_quality_model, op10_license_scan)
}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_substring_dedup": OP8_SQL}
