"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, html_extraction, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, ranked_search, source_mixing, suffix_dedup, token_alignment, token_counts

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_line_dedup": line_dedup.query,
    "op3_quality_classifier": quality_classifier.query,
    "op4_token_counts": token_counts.query,
    "op5_near_dedup": near_dedup.query,
    "op6_html_extraction": html_extraction.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_decontamination": decontamination.query,
    "op9_packing": packing.query,
    "op10_language_id": language_id.query,
    "op11_ranked_search": ranked_search.query,
    "op12_source_mixing": source_mixing.query,
    "op13_token_alignment": token_alignment.query,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_source_mixing": source_mixing.ORACLE,
}
