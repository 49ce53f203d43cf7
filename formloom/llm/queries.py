"""Registered queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from formloom.llm import alignment, htmltext, jaccard, mixing, pieces, pii, quality, repeats, resampling, revisits, syncmers, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality": quality.op2_quality,
    "op3_main_text": htmltext.op3_main_text,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": syncmers.op6_fingerprints,
    "op7_pieces": pieces.op7_pieces,
    "op8_repeats": repeats.op8_repeats,
    "op9_revisits": revisits.op9_revisits,
    "op10_mix": mixing.op10_mix,
    "op11_alignment": alignment.op11_alignment,
    "op12_topk": topk.op12_topk,
    "op13_resample": resampling.op13_resample,
}

ORACLES = {
    "op9_revisits": revisits.ORACLE,
    "op10_mix": mixing.ORACLE,
    "op12_topk": topk.SQL,
    "op13_resample": resampling.SQL,
}
