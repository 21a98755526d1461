"""Queries and their SQL of the text operators, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from casegrid.llm import bpe, chat, decontaminate, line_dedup, lloyd, merkle, mixture, ngram_join, quality_classifier, quality_rules, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_centroid_clustering": lloyd.op11_centroid_clustering,
    "op12_source_mix": mixture.op12_source_mix,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.OP1_SQL, "op8_chat_format": chat.OP8_SQL, "op11_centroid_clustering": lloyd.OP11_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
