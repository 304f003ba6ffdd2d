"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .chat_format import op9_chat_format
from .fill_middle import op13_fill_in_middle
from .line_dedup import op10_line_dedup
from .lm_scoring import op7_lm_scoring
from .mixing import op1_mixing
from .near_dup import op3_near_dup
from .oracle import ORACLES
from .packing import op4_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import op6_quality_rules, rule_ablations
from .simhash_dedup import op11_simhash_dedup
from .token_files import op5_token_files
from .topk_search import op8_topk_search
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dup": op3_near_dup,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "rule_ablations": rule_ablations,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_topk_search": op8_topk_search,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

__all__ = ["ORACLES", "QUERIES"]
