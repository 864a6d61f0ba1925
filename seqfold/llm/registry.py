"""The corpus queries and their SQL."""

from __future__ import annotations

from . import bpe, compact_windows, gif, html_extract, line_dedup, mixing, quality_rules, simhash, suffix_dedup, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_host_quality": quality_rules.op3_host_quality,
        "op4_suffix_array": suffix_dedup.op4_suffix_array,
        "op5_mixing": mixing.op5_mixing,
        "op6_gif": gif.op6_gif,
        "op7_simhash": simhash.op7_simhash,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_compact_windows": compact_windows.op9_compact_windows,
        "op10_html": html_extract.op10_html,
    }


def oracle_sql():
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op3_host_quality": quality_rules.SQL,
        "op5_mixing": mixing.SQL,
    }
