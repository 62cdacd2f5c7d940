"""Queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, chat, collocations, decontaminate, jaccard_join, ngram_lm, packing, periodic_runs, pseudonyms, quality, substring_dedup, toxicity, warc_store

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_packing": packing.op2_packing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_lm_scoring": ngram_lm.op4_lm_scoring,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_warc": warc_store.op8_warc,
    "op9_pii_pseudonyms": pseudonyms.op9_pii_pseudonyms,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op8_warc": warc_store.SQL,
    "op11_collocations": collocations.SQL,
}
