"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import (
    chaining,
    content_sort,
    context_mixing,
    golay,
    line_dedup,
    mixing,
    packing,
    quality,
    sharding,
    suffix_dedup,
)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_quality_rules": quality.query,
    "op4_simhash_golay": golay.query,
    "op5_kd_sharding": sharding.query,
    "op6_collinear_chaining": chaining.query,
    "op7_mixing": mixing.query,
    "op8_context_mixing": context_mixing.query,
    "op9_exact_dedup": content_sort.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
}
SQL = {"op2_line_dedup": line_dedup.SQL, "op7_mixing": mixing.SQL, "op9_exact_dedup": content_sort.SQL}
