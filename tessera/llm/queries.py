"""The corpus queries and the SQL that says the same, for the driver's contract."""

from __future__ import annotations

from tessera.llm import exact_dedup, filter_audit, fingerprints, hard_negatives, jaccard_join, language_id, line_dedup, mixing, packing, personal_data, revisits, sharding, url_filter

QUERIES = {
    "op1_warc_revisits": revisits.op1,
    "op2_sharding": sharding.op2,
    "op3_language_id": language_id.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_url_filter": url_filter.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_fingerprints": fingerprints.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_mixing": mixing.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_personal_data": personal_data.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

#: Sharding has no SQL (DuckDB has no CRC-32), nor have language ID, packing, fingerprints and personal data; tests hold those against
#: brute force.
ORACLES = {
    "op1_warc_revisits": revisits.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
