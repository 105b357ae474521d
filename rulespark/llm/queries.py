"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language_id, lm_score, near_dup, packing, sharding, substring_dedup, toxicity, url_filter, vector_search

_ALL = (lm_score.op1_lm_score, url_filter.op2_url_filter, near_dup.op3_near_dup, packing.op4_packing, sharding.op5_sharding, language_id.op6_language_id, toxicity.op7_toxicity, substring_dedup.op8_substring_dedup, vector_search.op9_vector_search, decontaminate.op10_decontaminate)

QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {"op2_url_filter": url_filter.SQL, "op10_decontaminate": decontaminate.SQL}
