"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroid_clustering, decontamination, importance_resampling, language_id, media_avi, near_duplicates, packing, pii, substring_dedup, suffix_dedup, token_counts, url_filters, warc

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_near_duplicates": near_duplicates.query,
    "op3_packing": packing.query,
    "op4_media_avi": media_avi.query,
    "op5_pii": pii.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_language_id": language_id.query,
    "op9_token_counts": token_counts.query,
    "op10_decontamination": decontamination.query,
    "op11_centroid_clustering": centroid_clustering.query,
    "op12_warc": warc.query,
    "op13_importance_resampling": importance_resampling.query,
}
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.ORACLE,
    "op11_centroid_clustering": centroid_clustering.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_importance_resampling": importance_resampling.ORACLE,
}
