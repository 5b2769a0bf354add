"""The registered query of each operator, and its SQL where there is one."""

from __future__ import annotations

from gaugeworks.llm import clusters, decontamination, html_text, language_model, merkle, near_dedup_query, packing, preferences, quality, repeats, secrets, shards, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_minhash_near_dedup": near_dedup_query.op2_minhash_near_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_sharding": shards.op6_sharding,
    "op7_suffix_array_dedup": repeats.op7_suffix_array_dedup,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_chat_formatting": preferences.op9_chat_formatting,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_centroid_clustering": clusters.op12_centroid_clustering,
    "op13_url_filters": urls.op13_url_filters,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_minhash_near_dedup": near_dedup_query.SQL,
    "op4_benchmark_decontamination": decontamination.SQL,
    "op7_suffix_array_dedup": repeats.SQL,
    "op8_lm_scoring": language_model.SQL,
    "op9_chat_formatting": preferences.SQL,
    "op10_secret_scans": secrets.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_centroid_clustering": clusters.SQL,
    "op13_url_filters": urls.SQL,
}
