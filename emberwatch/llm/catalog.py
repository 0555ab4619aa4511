"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from emberwatch.llm import ann, decontam, edit_counts, hardneg, langid, licenses, minmax, ngramjoin, packing, quality, sharding, spelling, urlfilter

QUERIES = {
    "op1_ngram_join": ngramjoin.op1,
    "op10_neighbours": ann.op10,
    "op11_hard_negatives": hardneg.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_minmax_dedup": minmax.op13,
    "op2_decontamination": decontam.op2,
    "op3_sharding": sharding.op3,
    "op4_quality": quality.op4,
    "op5_packing": packing.op5,
    "op6_license_scan": licenses.op6,
    "op7_url_filter": urlfilter.op7,
    "op8_language_mixture": langid.op8,
    "op9_edit_counts": edit_counts.op9,
}

ORACLES = {
    "op11_hard_negatives": hardneg.ORACLE,
    "op2_decontamination": decontam.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
}
