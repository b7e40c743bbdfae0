"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, license_scan, media, minhash_dedup, packing, secret_scan, substring_dedup, token_files


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_best_fit_packing": packing.query,
        "op4_media_columns": media.query,
        "op5_language_id": language_id.query,
        "op6_token_files": token_files.query,
        "op7_secret_scan": secret_scan.query,
        "op8_decontaminate": decontaminate.query,
        "op9_minhash_dedup": minhash_dedup.query,
        "op10_html_extract": html_extract.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.sql(),
        "op2_substring_dedup": substring_dedup.sql(),
        "op7_secret_scan": secret_scan.sql(),
        "op9_minhash_dedup": minhash_dedup.sql(),
    }
