"""Schemas of the library's tables; nothing is inferred."""

from __future__ import annotations

SOURCE = "struct<device_id:string,agent_version:string,ingest_key_id:string,vendor:string,product:string>"
HOST = "struct<hostname:string,os_family:string,os_name:string,os_version:string,ip:string,mac:string>"
PROCESS = "struct<pid:bigint,name:string,exe_path:string,cmd_line:string,sha256:string,created_time:string>"

EVENT = f"""
event_id string, tenant_id string, schema_version string, event_class string, activity string, event_time timestamp, event_time_str string,
time_inferred boolean, ingest_time timestamp, source_type string, source_event_id string, batch_id string, source {SOURCE}, host {HOST},
severity_hint string, unmapped string, process {PROCESS}, parent struct<pid:bigint,name:string,exe_path:string>, exit_code bigint,
user struct<name:string,domain:string,uid:string>, direction string, protocol string, src struct<ip:string,port:int>,
dst struct<ip:string,port:int,hostname:string>, bytes_sent bigint, bytes_received bigint, status string, logon_type string, src_ip string,
session_id string, failure_reason string, message string, category string, fields variant, raw string, raw_truncated boolean
"""
RAW_BATCH = f"tenant_id string, trace_id string, batch_id string, source_type string, ingest_time timestamp, source {SOURCE}, events array<variant>"
ENVELOPE = "tenant_id string, trace_id string, payload string"
HIT = """
tenant_id string, event_id string, event_time timestamp, rule_id string, rule_version string, title string, severity string,
mitre_technique_ids array<string>, entity_key string, entity_user string, entity_hostname string, es_index string, pack_version string
"""
OBSERVATION = """
tenant_id string, observed_at timestamp, source string, hostname string, os_family string, os_name string, os_version string, ip string,
mac string, device_id string, agent_version string
"""
DEAD_LETTER = "tenant_id string, stage string, code string, detail string, source_type string, raw_payload binary, at timestamp"
AUDIT = "tenant_id string, actor string, action_type string, target string, before string, after string, reason_code string, created_at timestamp"
METERING = "tenant_id string, call_type string, alert_id string, model_id string, tokens_in int, tokens_out int, cost_usd decimal(12,6), latency_ms int, outcome string, created_at timestamp"

# Plans, platform settings and the order in which a purge empties tables.
PLAN_CONFIG = [
    ("trial", "trial_duration_days", "14"), ("trial", "endpoint_cap", "100"), ("trial", "retention_days", "14"), ("trial", "deep_investigation_daily_quota", "5"),
    ("trial", "response_mode", '"recommend_only"'), ("trial", "ingest_events_per_min", "5000"), ("core", "endpoint_cap", "250"), ("core", "retention_days", "30"),
    ("core", "deep_investigation_daily_quota", "5"), ("core", "response_mode", '"recommend_only"'), ("core", "ingest_events_per_min", "10000"), ("pro", "endpoint_cap", "1000"),
    ("pro", "retention_days", "90"), ("pro", "deep_investigation_daily_quota", "-1"), ("pro", "response_mode", '"playbooks_with_approval"'), ("pro", "ingest_events_per_min", "40000"),
]
PLATFORM_CONFIG = {
    "alert_dedup_window_minutes": "60", "correlation_window_minutes": "30", "enrollment_token_default_expiry_hours": "72", "audit_retention_days": "365",
    "billable_window_days": "30", "dlq_retention_days": "7", "trial_purge_after_days": "30", "heartbeat_interval_seconds": "60",
    "agent_offline_after_missed_heartbeats": "3", "cert_renewal_overlap_hours": "24", "ingest_batch_max_events": "1000", "ingest_batch_max_bytes": "5242880",
    "enroll_rate_limit_per_token_per_min": "30", "enroll_rate_limit_per_ip_per_min": "10", "token_velocity_alert_per_hour": "50",
    "signup_per_ip_hourly_threshold": "5", "rule_error_disable_fraction": "0.05", "rule_error_min_tenants": "3", "triage_daily_token_budget": "2000000",
}
PURGE_ORDER = (
    "deep_investigation_runs", "alert_events", "alert_history", "alerts", "correlation_groups", "devices", "asset_merge_audit", "asset_identity_pins",
    "asset_identities", "enrollment_tokens", "ingest_keys", "assets", "rule_toggles", "dead_letter_events", "onboarding_steps", "usage_counters",
)


def purge_order(tables: list[str]) -> list[str]:
    """Tables so that what refers to others goes first; unknown ones before all."""
    return sorted(tables, key=lambda t: (PURGE_ORDER.index(t) if t in PURGE_ORDER else -1, t))
