"""The ten operators as queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, media, mixing, near_duplicates, passages, quality_classifier, quality_rules, secrets, sharding, toxicity

QUERIES = {
    "op2_bayes_jaccard": near_duplicates.op2_bayes_jaccard,
    "op1_mjpeg_shots": media.op1_mjpeg_shots,
    "op3_ftrl_toxicity": toxicity.op3_ftrl_toxicity,
    "op4_compression_bands": quality_rules.op4_compression_bands,
    "op5_mix_to_weights": mixing.op5_mix_to_weights,
    "op6_bpe_automaton": bpe.op6_bpe_automaton,
    "op7_subword_quality": quality_classifier.op7_subword_quality,
    "op8_collinear_passages": passages.op8_collinear_passages,
    "op9_feistel_shards": sharding.op9_feistel_shards,
    "op10_structural_secrets": secrets.op10_structural_secrets,
}

ORACLES = {
    "op5_mix_to_weights": mixing.OP5_SQL,
}
