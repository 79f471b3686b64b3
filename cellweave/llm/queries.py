"""The registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from .licenses import OP6_SQL, op6_licenses
from .media import op1_media
from .mixing import OP10_SQL, op10_mixing
from .near_dedup import op4_near_dedup
from .negatives import OP11_SQL, op11_hard_negatives
from .packing import op5_packing
from .quality import op7_quality
from .secrets import OP8_SQL, op8_secrets
from .simhash import op12_simhash
from .substrings import op2_substrings
from .token_ids import op9_token_ids
from .vectors import op3_nearest

QUERIES = {
    "op1_media": op1_media,
    "op2_substrings": op2_substrings,
    "op3_nearest": op3_nearest,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_token_ids": op9_token_ids,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
}

SQL = {
    "op6_licenses": OP6_SQL,
    "op8_secrets": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}
