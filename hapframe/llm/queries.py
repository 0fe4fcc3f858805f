"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from hapframe.llm import decontaminate, html_text, mixing, neardup, quality_model, quality_rules, repeats, secret_scan, tokens, urls

QUERIES = {
    "op1_token_shards": tokens.op1_token_shards,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_html_text": html_text.op3_html_text,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_repeat_removal": repeats.op7_repeat_removal,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_url_filter": urls.op10_url_filter,
}
ORACLE_SQL = {"op4_quality_rules": quality_rules.SQL, "op6_source_mix": mixing.SQL, "op10_url_filter": urls.SQL}
