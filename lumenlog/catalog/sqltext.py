"""SQL fragments shared by the oracles."""

from __future__ import annotations

BUCKET = """CASE WHEN duration_ms IS NULL THEN 'P_UNKNOWN' WHEN duration_ms < 50 THEN 'P_SUB_50MS' WHEN duration_ms < 200 THEN 'P_50_200MS'
  WHEN duration_ms < 500 THEN 'P_200_500MS' WHEN duration_ms < 1000 THEN 'P_500_1000MS' ELSE 'P_OVER_1000MS' END"""
OUTCOME = """CASE WHEN error_code IS NOT NULL THEN 'FAILED' WHEN duration_ms IS NULL THEN 'EDGE_CASE' WHEN duration_ms >= 1000 THEN 'WARNING' ELSE 'SUCCESS' END"""
ROLE = "CASE WHEN user_id IS NULL THEN NULL WHEN user_role_raw IN ('admin','user','premium','guest') THEN user_role_raw ELSE 'guest' END"
SUMMARY = f"""'Outcome: ' || {OUTCOME} || ', Service: ' || service || ', Route: ' || route || ', Error: ' || coalesce(error_code, 'NONE') || ', ErrorMessage: '
  || coalesce(error_message, 'NONE') || ', UserRole: ' || coalesce({ROLE}, 'ANONYMOUS') || ', LatencyBucket: ' || {BUCKET}"""
SERVICE_NAME = "CASE service WHEN 'payments' THEN 'payment' WHEN 'embeddings' THEN 'embedding' ELSE service END"
PATH = "regexp_replace(route, '^(GET|POST|PUT|DELETE|PATCH)\\s+', '', 'i')"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
ROUTE_NAME = f"""CASE WHEN len({SEGMENTS}) > 1 THEN CASE {SEGMENTS}[-1] WHEN 'profile' THEN 'profile access' WHEN 'register' THEN 'registration' ELSE {SEGMENTS}[-1] END
  ELSE coalesce(nullif({PATH}, ''), route) END"""
ROLE_NAME = f"lower(coalesce({ROLE}, 'ANONYMOUS'))"
ERROR_NAME = """CASE error_code WHEN 'UNAUTHORIZED' THEN 'authorization failure' WHEN 'NOT_FOUND' THEN 'resource not found' ELSE lower(replace(error_code, '_', ' ')) END"""
NARRATIVE = f"""CASE {OUTCOME}
  WHEN 'FAILED' THEN 'A ' || {ROLE_NAME} || ' user experienced a ' || {SERVICE_NAME} || ' failure during ' || {ROUTE_NAME} || ' due to ' || {ERROR_NAME} || coalesce(': ' || error_message, '') || '.'
  WHEN 'WARNING' THEN 'A ' || {ROLE_NAME} || ' user encountered slow performance during ' || {SERVICE_NAME} || ' ' || {ROUTE_NAME} || '.'
  WHEN 'EDGE_CASE' THEN 'An edge case occurred for a ' || {ROLE_NAME} || ' user during ' || {SERVICE_NAME} || ' ' || {ROUTE_NAME} || '.'
  ELSE 'A ' || {ROLE_NAME} || ' user successfully completed ' || {SERVICE_NAME} || ' ' || {ROUTE_NAME} || '.' END"""
DUAL = f"{NARRATIVE} || chr(10) || chr(10) || {SUMMARY}"

# View of events with their dual-layer text.
DUAL_VIEW = f"dual AS (SELECT *, {DUAL} AS dual_text, {SUMMARY} AS summary_text FROM wide_events)"
