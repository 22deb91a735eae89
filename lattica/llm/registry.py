"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .embedding_dedup import op5_embedding_dedup
from .html_text import op7_html_text
from .jaccard_join import op1_jaccard_join
from .license_scan import op4_license_scan
from .oracles import ORACLE_SQL
from .packing import op2_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op9_quality_rules
from .secret_scan import op10_secret_scan
from .token_count import op6_token_count

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_count": op6_token_count,
    "op7_html_text": op7_html_text,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
