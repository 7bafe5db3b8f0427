"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from facsimile.llm import (
    decontamination, html_extraction, jaccard_join, language_model, packing, phrases, quality_classifier, quality_rules,
    sharding, simhash, suffix_dedup, toxicity, vector_codes)

QUERIES = {
    "op1_cotraining_quality": quality_classifier.query,
    "op2_toxicity_neighbours": toxicity.query,
    "op3_suffix_factors": suffix_dedup.query,
    "op4_site_templates": html_extraction.query,
    "op5_signature_trees": jaccard_join.query,
    "op6_vector_sharding": sharding.query,
    "op7_dynamic_packing": packing.query,
    "op8_string_tiling": decontamination.query,
    "op9_quality_rules": quality_rules.query,
    "op10_elias_fano_lm": language_model.query,
    "op11_pigeonring_simhash": simhash.query,
    "op12_cover_tree_codes": vector_codes.query,
    "op13_prefix_free_phrases": phrases.query,
}
ORACLES = {
    "op9_quality_rules": quality_rules.oracle(),
    "op12_cover_tree_codes": vector_codes.oracle(),
    "op13_prefix_free_phrases": phrases.oracle(),
}
