"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, sharding, simhash, substring_dedup, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_token_files": token_files.op6_token_files,
    "op7_bpe": bpe.op7_bpe,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_token_counts": token_counts.OP5_SQL,
}
