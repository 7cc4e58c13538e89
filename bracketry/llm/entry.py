"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from bracketry.llm import context_mixing, decontamination, jaccard_join, license_scan, packing, quality_crf, quality_rules, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_classifier": quality_crf.op1_quality_classifier,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_lm_scoring": context_mixing.op5_lm_scoring,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_warc": warc.op8_warc,
    "op9_license_scans": license_scan.op9_license_scans,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {
    "op4_url_filters": url_filter.OP4_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op7_ngram_jaccard_join": jaccard_join.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
