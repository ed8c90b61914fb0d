"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import sharding, sql
from .classifier import op10_quality_classifier
from .decontamination import op6_decontamination
from .jaccard_join import op2_jaccard_join
from .line_dedup import op4_line_dedup
from .mixing import op7_source_mixing
from .pii import op9_pii
from .quality_rules import op1_quality_rules
from .substring_dedup import op3_substring_dedup
from .token_output import op5_token_output

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_output": op5_token_output,
    "op6_decontamination": op6_decontamination,
    "op7_source_mixing": op7_source_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_pii": op9_pii,
    "op10_quality_classifier": op10_quality_classifier,
}

SQL: dict[str, str] = dict(sql.SQL)
