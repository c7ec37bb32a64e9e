"""The corpus queries and their SQL."""

from . import op2_suffix_dedup, op3_quality, op6_mixing, op7_chat, op8_url_filters, op10_jaccard_join
from .op1_fingerprints import op1_fingerprints
from .op4_tokens import op4_tokens
from .op5_packing import op5_packing
from .op9_html import op9_html

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_suffix_dedup": op2_suffix_dedup.op2_suffix_dedup,
    "op3_quality": op3_quality.op3_quality,
    "op4_tokens": op4_tokens,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_chat": op7_chat.op7_chat,
    "op8_url_filters": op8_url_filters.op8_url_filters,
    "op9_html": op9_html,
    "op10_jaccard_join": op10_jaccard_join.op10_jaccard_join,
}

SQL = {
    "op2_suffix_dedup": op2_suffix_dedup.SQL,
    "op3_quality": op3_quality.SQL,
    "op6_mixing": op6_mixing.SQL,
    "op7_chat": op7_chat.SQL,
    "op8_url_filters": op8_url_filters.SQL,
    "op10_jaccard_join": op10_jaccard_join.SQL,
}
