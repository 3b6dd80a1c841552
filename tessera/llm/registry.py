"""Queries of the text operators and their SQL."""

from __future__ import annotations

from tessera.llm import attention_lm, bpe, chosen_path, language_id, licenses, mixing, quality, sharding, token_counts, topk


def queries():
    found = (
        language_id.op1_language_id,
        token_counts.op2_token_counts,
        mixing.op3_mixing,
        licenses.op4_license_scan,
        quality.op5_quality_rules,
        topk.op6_exact_top_k,
        bpe.op7_bpe_encode_decode,
        chosen_path.op8_ngram_jaccard_join,
        sharding.op9_sharding,
        attention_lm.op10_attention_lm,
    )
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op4_license_scan": licenses.SQL, "op5_quality_rules": quality.SQL, "op6_exact_top_k": topk.SQL, "op8_ngram_jaccard_join": chosen_path.SQL}
