"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from cairn.llm import queries as q


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix_sources": q.op1_mix_sources,
        "op2_quality_rules": q.op2_quality_rules,
        "op3_byte_bpe": q.op3_byte_bpe,
        "op4_substring_dedup": q.op4_substring_dedup,
        "op5_html_extraction": q.op5_html_extraction,
        "op6_license_scan": q.op6_license_scan,
        "op7_warc": q.op7_warc,
        "op8_embedding_dedup": q.op8_embedding_dedup,
        "op9_jaccard_join": q.op9_jaccard_join,
        "op10_sst_shards": q.op10_sst_shards,
        "op11_importance_resampling": q.op11_importance_resampling,
        "op12_nearest_neighbours": q.op12_nearest_neighbours,
        "op13_conversation_repair": q.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": q.OP1_SQL,
        "op2_quality_rules": q.OP2_SQL,
        "op4_substring_dedup": q.OP4_SQL,
        "op7_warc": q.OP7_SQL,
        "op8_embedding_dedup": q.OP8_SQL,
        "op9_jaccard_join": q.OP9_SQL,
        "op11_importance_resampling": q.OP11_SQL,
        "op13_conversation_repair": q.OP13_SQL,
    }
