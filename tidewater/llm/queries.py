"""The registered queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

from . import bpe, chat, embeddings, golden, mixing, oracles, phrases, pieces, quality, recompression, simhash, suffix_array, token_counts, warc

QUERIES = {
    "op1_substring_dedup": recompression.query,
    "op2_chat_formatting": chat.query,
    "op3_token_counts": token_counts.query,
    "op4_suffix_array_dedup": suffix_array.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_bpe": bpe.query,
    "op7_quality_rules": quality.query,
    "op8_embedding_near_dedup": embeddings.query,
    "op9_source_mixing": mixing.query,
    "op10_warc": warc.query,
    "op11_sentencepiece": pieces.query,
    "op12_golden_records": golden.query,
    "op13_collocations": phrases.query,
}
#: DuckDB SQL for those that it can express over whole tables; the others are tested against brute force.
ORACLE_SQL = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op2_chat_formatting": oracles.CHAT_FORMATTING,
    "op7_quality_rules": oracles.QUALITY_RULES,
    "op8_embedding_near_dedup": oracles.EMBEDDING_NEAR_DEDUP,
    "op10_warc": oracles.WARC,
    "op12_golden_records": oracles.GOLDEN_RECORDS,
    "op13_collocations": oracles.COLLOCATIONS,
}
