"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm import (
    bpe, classifier, context_mixing, conversation_repair, exact_dedup, mixing, near_dup, piece_bpe, sharding, substring_dedup, topk, url_filter, whitening)


def _table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES = {
    "op1_byte_bpe": lambda spark, folder: bpe.op1_byte_bpe(_table(spark, folder, "documents")),
    "op11_piece_bpe": lambda spark, folder: piece_bpe.op11_piece_bpe(_table(spark, folder, "documents")),
    "op12_whitening": lambda spark, folder: whitening.op12_whitening(_table(spark, folder, "embeddings")),
    "op13_conversation_repair": lambda spark, folder: conversation_repair.op13_conversation_repair(_table(spark, folder, "conversations")),
    "op2_context_mixing": lambda spark, folder: context_mixing.op2_context_mixing(_table(spark, folder, "documents")),
    "op10_quality": lambda spark, folder: classifier.op10_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels")),
    "op3_url_reputation": lambda spark, folder: url_filter.op3_url_reputation(_table(spark, folder, "pages"), _table(spark, folder, "labels")),
    "op4_near_duplicates": lambda spark, folder: near_dup.op4_near_duplicates(_table(spark, folder, "documents")),
    "op5_byte_shards": lambda spark, folder: sharding.op5_byte_shards(_table(spark, folder, "documents")),
    "op6_mix_sources": lambda spark, folder: mixing.op6_mix_sources(_table(spark, folder, "documents")),
    "op7_exact_dedup": lambda spark, folder: exact_dedup.op7_exact_dedup(_table(spark, folder, "documents")),
    "op8_topk_vectors": lambda spark, folder: topk.op8_topk_vectors(_table(spark, folder, "embeddings")),
    "op9_substring_dedup": lambda spark, folder: substring_dedup.op9_substring_dedup(_table(spark, folder, "documents")),
}

ORACLES = {
    "op13_conversation_repair": conversation_repair.OP13_SQL,
    "op3_url_reputation": url_filter.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_topk_vectors": topk.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
