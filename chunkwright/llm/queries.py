"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from chunkwright.llm import decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, sharding, telephony, token_coding, url_reputation

QUERIES = {
    "op1_telephony_audio": telephony.query,
    "op2_line_chunk_dedup": line_dedup.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_jump_sharding": sharding.query,
    "op5_host_reputation": url_reputation.query,
    "op6_html_extraction": html_extract.query,
    "op7_token_id_coding": token_coding.query,
    "op8_language_id": language_id.query,
    "op9_source_mixing": mixing.query,
    "op10_ngram_jaccard_join": ngram_join.query,
}

ORACLES = {
    "op2_line_chunk_dedup": line_dedup.SQL,
    "op3_benchmark_decontamination": decontaminate.SQL,
    "op4_jump_sharding": sharding.SQL,
    "op5_host_reputation": url_reputation.SQL,
    "op9_source_mixing": mixing.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
}
