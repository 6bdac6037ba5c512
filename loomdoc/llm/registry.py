"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from loomdoc.llm import contract, oracles

QUERIES = {
    "op1_sharding": contract.op1_sharding,
    "op2_near_duplicates": contract.op2_near_duplicates,
    "op3_quality_rules": contract.op3_quality_rules,
    "op4_byte_bpe": contract.op4_byte_bpe,
    "op5_top_k": contract.op5_top_k,
    "op6_url_filters": contract.op6_url_filters,
    "op7_token_files": contract.op7_token_files,
    "op8_chat_format": contract.op8_chat_format,
    "op9_mixing": contract.op9_mixing,
    "op10_line_dedup": contract.op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": oracles.QUALITY,
    "op5_top_k": oracles.TOP_K,
    "op6_url_filters": oracles.URLS,
    "op9_mixing": oracles.MIXING,
    "op10_line_dedup": oracles.LINES,
}
