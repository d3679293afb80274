"""Schemas of the tables, as DDL strings."""

KINDS = ("decision", "fact", "preference", "constraint", "state", "code")
CONFLICTABLE = ("decision", "preference", "constraint", "fact")
PROVENANCE = "struct<source:string,tool:string,model:string,ts:bigint>"
EVENT = "source string, tool string, model string, ts bigint, project string, role string, text string, kind string"
MEMORY = f"id bigint, source string, tool string, model string, ts bigint, project string, role string, text string, kind string, status string, seen_count int, importance double, last_seen bigint, sources array<{PROVENANCE}>, superseded_by bigint, created_at bigint, updated_at bigint"
CONTRADICTION = "id bigint, project string, topic string, active_id bigint, superseded_id bigint, active_text string, superseded_text string, active_source string, superseded_source string, active_ts bigint, superseded_ts bigint, created_at bigint"
CANDIDATE = "array<struct<text:string,kind:string,confidence:double>>"
