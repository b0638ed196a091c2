"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from lorikeet.llm import chatformat, exact_dedup, imatch, langid, linededup, lmscore, mixing, packing, simhash, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_chat_format": chatformat.op3_chat_format,
    "op4_lm_score": lmscore.op4_lm_score,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_imatch": imatch.op6_imatch,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op3_chat_format": chatformat.OP3_SQL,
    "op4_lm_score": lmscore.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
}
