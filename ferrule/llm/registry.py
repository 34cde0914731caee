"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, langid, lm_attention, ngram_jaccard, quality, sharding, token_count, toxicity, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard": ngram_jaccard.query,
        "op2_byte_bpe": bpe.query,
        "op3_decontamination": decontaminate.query,
        "op4_lm_attention": lm_attention.query,
        "op5_language_id": langid.query,
        "op6_toxicity": toxicity.query,
        "op7_warc": warc.query,
        "op8_quality_rules": quality.query,
        "op9_token_counts": token_count.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_jaccard.ORACLE, "op7_warc": warc.ORACLE, "op8_quality_rules": quality.ORACLE}
