"""The subpackage's registered queries and their DuckDB statements."""

from __future__ import annotations

from kiln.llm import embed_dedup, license_scan, line_dedup, lm_score, merkle, mixing, order_minhash, packing, pii, quality, secret_scan, token_align, url_filter

QUERIES = {
    "op1_secret_scans": secret_scan.query,
    "op2_packing": packing.query,
    "op3_url_filters": url_filter.query,
    "op4_quality_rules": quality.query,
    "op5_lm_scoring": lm_score.query,
    "op6_line_dedup": line_dedup.query,
    "op7_embedding_near_dedup": embed_dedup.query,
    "op8_pii": pii.query,
    "op9_mixing": mixing.query,
    "op10_minhash_near_dedup": order_minhash.query,
    "op11_token_alignment": token_align.query,
    "op12_license_scans": license_scan.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLES = {
    "op1_secret_scans": secret_scan.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
