"""The queries of this subpackage; an import error here means that the subpackage is not there."""

from __future__ import annotations

from timedtext.llm import bpe, collocations, importance, line_dedup, mixing, near_dup, nearest, quality, secret_scan, style_tree, token_counts, toxicity, vector_dedup


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_bpe": bpe.op2_bpe,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_nearest": nearest.op5_nearest,
        "op6_quality": quality.op6_quality,
        "op7_near_dup": near_dup.op7_near_dup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_vector_dedup": vector_dedup.op10_vector_dedup,
        "op11_collocations": collocations.op11_collocations,
        "op12_main_text": style_tree.op12_main_text,
        "op13_resample": importance.op13_resample,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.SQL,
        "op5_nearest": nearest.SQL,
        "op7_near_dup": near_dup.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_vector_dedup": vector_dedup.SQL,
        "op11_collocations": collocations.SQL,
        "op13_resample": importance.SQL,
    }
