"""Registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from ravelin.llm import chat, conversation_repair, decontamination, fingerprints, html_text, language_model, line_dedup, minhash, packing, periodic_runs, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_perspectives": chat.op1_perspectives,
    "op2_winnowing": decontamination.op2_winnowing,
    "op3_pu_toxicity": toxicity.op3_pu_toxicity,
    "op4_line_windows": line_dedup.op4_line_windows,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_line_blocks": html_text.op7_line_blocks,
    "op8_dart_minhash": minhash.op8_dart_minhash,
    "op9_log_bilinear": language_model.op9_log_bilinear,
    "op10_histogram_topk": topk.op10_histogram_topk,
    "op11_scaled_sketch": fingerprints.op11_scaled_sketch,
    "op12_recursive_repair": conversation_repair.op12_recursive_repair,
    "op13_lyndon_runs": periodic_runs.op13_lyndon_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op1_perspectives": chat.ORACLE,
    "op2_winnowing": decontamination.ORACLE,
    "op4_line_windows": line_dedup.ORACLE,
    "op10_histogram_topk": topk.ORACLE,
    "op12_recursive_repair": conversation_repair.ORACLE,
    "op13_lyndon_runs": periodic_runs.ORACLE,
}
