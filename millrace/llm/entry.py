"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, collocations, mixing, neardup, phrases, pii, quality, repeats, sharding, tokenfiles, topk, toxicity, whitening

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_top_k": topk.op3_top_k,
    "op4_repeats": repeats.op4_repeats,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_phrases": phrases.op11_phrases,
    "op12_collocations": collocations.op12_collocations,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {**topk.ORACLE, **mixing.ORACLE, **quality.ORACLE, **sharding.ORACLE, **phrases.ORACLE, **collocations.ORACLE}
