"""The registered queries of this folder and, where SQL can express one, the same rows in DuckDB's SQL."""

from __future__ import annotations

from . import ann, codes, collocations, fingerprint, jaccard, language, linededup, mixing, packing, pseudonyms, quality, simhash, toxicity

QUERIES = {
    "op1_ann": ann.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_source_mix": mixing.query,
    "op4_fingerprint": fingerprint.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_language": language.query,
    "op8_pseudonyms": pseudonyms.query,
    "op9_line_dedup": linededup.query,
    "op10_best_fit": packing.query,
    "op11_simhash": simhash.query,
    "op12_vector_codes": codes.query,
    "op13_collocations": collocations.query,
}
ORACLES = {"op3_source_mix": mixing.ORACLE, "op12_vector_codes": codes.ORACLE, "op13_collocations": collocations.ORACLE}
