"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewheel.llm import conversation_repair, hard_negatives, language_id, license_scan, lm_scoring, media, near_dedup, packing, private_data, source_mix, substring_dedup, topk_search, url_rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (language_id, lm_scoring, media, near_dedup, packing, private_data, source_mix, substring_dedup, topk_search, url_rules, license_scan, hard_negatives, conversation_repair):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
