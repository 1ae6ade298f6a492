"""Explicit schemas of the catalogue's tables and the enumerations that its documents use."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "artifacts": "function_id string, file_path string, function_name string, signature string, body string, code_hash string, language string,"
    " start_line int, end_line int, parent string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "contracts": "function_id string, contract_json string, confidence_score float, verification_script string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "queue": "function_id string, priority int, status string, reason string, attempts int, max_attempts int, error_message string,"
    " created_at timestamp_ntz, updated_at timestamp_ntz",
    "dependencies": "caller_id string, callee_id string, created_at timestamp_ntz",
    "reasoning_traces": "id int, function_id string, agent string, trace_json string, created_at timestamp_ntz",
    "config": "key string, value string, updated_at timestamp_ntz",
    "vision_findings": "id int, function_id string, finding_type string, significance string, description string, location string,"
    " invariant_implication string, status string, resolution_note string, plot_path string, created_at timestamp_ntz",
    "learning_history": "id int, commit_sha string, commit_message string, function_id string, pattern_type string, pattern_description string,"
    " contract_modified boolean, confidence_boost float, new_invariants_added int, invariants_validated int, created_at timestamp_ntz",
}
#: Columns that identify a row of each table.
KEYS: dict[str, list[str]] = {
    "artifacts": ["function_id"], "contracts": ["function_id"], "queue": ["function_id"], "dependencies": ["caller_id", "callee_id"],
    "reasoning_traces": ["id"], "config": ["key"], "vision_findings": ["id"], "learning_history": ["id"],
}
# The enumerations.
ARTIFACT_STATUSES = ("PENDING", "VERIFIED", "NEEDS_REVIEW", "STALE", "BROKEN")
CRITICALITIES = ("HIGH", "MEDIUM", "LOW")
ON_FAIL = ("error", "warn")
CONTRACT_DDL = "function_signature string, intent_summary string, invariants array<struct<name:string,logic:string,criticality:string,on_fail:string>>, io_examples array<struct<input:variant,output:variant,description:string>>"
