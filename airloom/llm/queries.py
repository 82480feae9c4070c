"""The registered queries of this subpackage and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.llm import alignment, lines, minhash, mixing, order_minhash, passages, ppm, prefix_trie, quality, sentence_pieces, shards, topk, toxicity


def op8_quality_rules(spark, sf_dir):
    return quality.op8(spark, sf_dir).withColumn("host_rate", F.round("host_rate", 9))


QUERIES = {
    "op1_minhash_near_dedup": minhash.op1,
    "op2_exact_topk": topk.op2,
    "op3_lm_scoring": ppm.op3,
    "op4_sharding": shards.op4,
    "op5_sentence_pieces": sentence_pieces.op5,
    "op6_substring_dedup": passages.op6,
    "op7_mixing": mixing.op7,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": lines.op9,
    "op10_toxicity": toxicity.op10,
    "op11_order_minhash": order_minhash.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_tokenizer_alignment": alignment.op13,
}

ORACLES = {
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op6_substring_dedup": passages.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op2_exact_topk": topk.OP2_SQL,
    "op8_quality_rules": quality.OP8_SQL,
}
