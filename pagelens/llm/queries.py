"""The queries of this subpackage and the SQL that answers them."""

from __future__ import annotations

from pagelens.llm import collocations, decontamination, licenses, media, mixing, ngram_join, pii, quality, secrets, sharding, substrings, toxicity, vector_codes

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_pii": pii.op6_pii,
    "op7_substrings": substrings.op7_substrings,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_media": media.op10_media,
    "op11_licenses": licenses.op11_licenses,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op1_secrets": secrets.op1_sql(),
    "op3_sharding": sharding.op3_sql(),
    "op4_ngram_join": ngram_join.op4_sql(),
    "op6_pii": pii.op6_sql(),
    "op7_substrings": substrings.op7_sql(),
    "op8_mixing": mixing.op8_sql(),
    "op11_licenses": licenses.op11_sql(),
    "op12_vector_codes": vector_codes.op12_sql(),
    "op13_collocations": collocations.op13_sql(),
}
