"""Schemas of the state tables. Times are epoch seconds; ``row_seq`` is the order of arrival and ends every tie."""

from __future__ import annotations

STATE = {
    "facts": "id string, row_seq long, content string, embedding array<float>, type string, target string, scope_id string, status string, activation double, q_value double, access_count int, metabolic_rate double, importance double, category string, layer string, pinned boolean, created_at double, updated_at double, last_accessed double, source_hash string, superseded_by string, provenance map<string,string>",
    "scopes": "id string, label string, status string, last_used double",
    "links": "source_id string, target_id string, strength double, npmi double, co int, link_type string, last_updated double",
    "access": "fact_id string, seen_at double",
    "qvalues": "id string, q double, n_retrieved int, updated_at double",
    "pending": "id string, row_seq long, content string, type string, target string, scope_id string, session_id string, source string, status string, updated_at double, provenance map<string,string>",
    "interactions": "ix long, query string, scope string, recalled_ids array<string>, followed_by_store boolean",
    "metrics": "session_id string, source string, promoted long, retracted long",
}
