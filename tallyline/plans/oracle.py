"""ANSI SQL twins of the derived tables, put together per check as common table expressions."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *needs: str):
    def add(sql: str) -> None:
        CTES[name] = (needs, sql)

    return add


def with_tables(body: str, *names: str, extra: str = "") -> str:
    """Prefix a query with the derived tables it reads (in dependency order)."""
    done: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in done]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " " + body


cte("facts0")(
    """SELECT event_id AS event_number, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
    epoch_us(ts)//1000 AS occurred_at_ms, user_id, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(round(value*100) AS BIGINT) AS total_tokens FROM events"""
)
cte("facts1", "facts0")(
    """SELECT *, CASE WHEN k%10<>0 THEN total_tokens//4 END AS output_total,
    CASE WHEN k%10<>0 THEN total_tokens-total_tokens//4 END AS input_total FROM facts0"""
)
cte("facts2", "facts1")(
    """SELECT *, 'l'||user_id AS ledger_id, 's'||user_id AS session_key,
    CASE WHEN event_type<>'error' THEN event_type END AS model,
    CASE user_id%3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS provider,
    CASE WHEN k%7<>0 THEN 'p'||(k%7) END AS project_id,
    CASE WHEN k%11<>0 THEN 't'||(event_number//5) END AS turn_id,
    CASE WHEN k%4=0 THEN ['src0','src1'] ELSE ['src0'] END AS source_ids,
    CASE WHEN k%10>1 THEN input_total//2 END AS cached_input,
    CASE WHEN k%5<>0 THEN input_total//8 END AS cache_write_input,
    CASE WHEN k%4<>0 THEN output_total//3 END AS reasoning_output,
    total_tokens AS reported_total FROM facts1"""
)
cte("facts", "facts2")(
    """SELECT *, input_total-cached_input AS noncached_input,
    CASE WHEN model IS NOT NULL THEN 'model:'||sha256('['||CASE WHEN provider IS NULL THEN 'null'
      ELSE '"'||provider||'"' END||',"'||model||'"]') END AS model_key,
    CASE WHEN model IS NULL THEN '未知模型' ELSE model||coalesce(' · '||provider,'') END AS model_label
    FROM facts2"""
)
cte("sessions")(
    """SELECT 's'||u AS session_key, CASE WHEN u%13<>0 THEN 'conv-'||u END AS provider_session_id,
    CASE WHEN u%10<>0 THEN 'm'||(u//10*10) END AS parent_key,
    CASE WHEN u%10<>0 THEN 'conv-'||(u//10*10) END AS parent_provider_id,
    CASE WHEN u%17<>0 THEN 'l'||u END AS active_ledger_id
    FROM (SELECT DISTINCT user_id AS u FROM events)"""
)
cte("aliases", "sessions")(
    """SELECT 'm'||substring(session_key,2) AS alias_session_key, session_key AS canonical_session_key
    FROM sessions WHERE CAST(substring(session_key,2) AS BIGINT)%10=0"""
)
cte("projects", "facts")(
    """SELECT project_id, 'Project '||n AS display_name, CASE WHEN n%3=0 THEN 'Team '||n END AS user_alias
    FROM (SELECT DISTINCT project_id, CAST(substring(project_id,2) AS INTEGER) AS n FROM facts
    WHERE project_id IS NOT NULL)"""
)
cte("ledgers", "sessions")(
    """SELECT 'l'||u AS ledger_id, session_key,
    CASE WHEN u%2=0 THEN 'rollout-v1' ELSE 'rollout-v0' END AS parser_version,
    CASE WHEN u%3=0 THEN 'accounting-v1' ELSE 'accounting-v2' END AS accounting_version
    FROM (SELECT session_key, CAST(substring(session_key,2) AS BIGINT) AS u FROM sessions)"""
)
cte("provenance", "facts")(
    """SELECT event_id, 'o-'||event_id||'-'||source_id AS observation_id, source_id,
    CASE WHEN source_id='src0' THEN 'origin' ELSE 'mirror' END AS role,
    'g-'||source_id||'-'||user_id AS file_generation_id, event_number*100 AS byte_offset, user_id
    FROM (SELECT event_id, event_number, user_id, unnest(source_ids) AS source_id FROM facts)"""
)
cte("generations", "provenance")(
    """SELECT file_generation_id, 'f-'||substring(file_generation_id,3) AS file_id, 'current' AS state,
    3 AS checkpoint_revision, source_id, user_id, max(byte_offset)+100 AS observed_size,
    max(byte_offset)+100 - CASE WHEN user_id%23=0 THEN 50 ELSE 0 END AS committed_offset
    FROM provenance GROUP BY file_generation_id, source_id, user_id"""
)
cte("files", "generations")(
    """SELECT file_id, source_id, user_id, '/logs/'||file_id||'.jsonl' AS canonical_path,
    file_generation_id AS current_generation_id,
    CASE WHEN user_id%19=0 THEN 'missing' ELSE 'present' END AS status FROM generations"""
)
cte("sources", "files")(
    """SELECT source_id, '/roots/'||source_id AS root_path, source_id<>'src9' AS enabled,
    CASE WHEN source_id='src1' THEN 'partially_readable' ELSE 'readable' END AS readability,
    1706000000000 AS last_success_ms
    FROM (SELECT DISTINCT source_id FROM files UNION ALL SELECT 'src9')"""
)
cte("scan_state", "sources")(
    """SELECT source_id, 7 AS scan_revision, root_path AS source_root,
    CASE WHEN source_id='src0' THEN 'ready' ELSE 'incomplete' END AS state, true AS discovery_complete,
    false AS invalidated, CAST(NULL AS VARCHAR) AS issue_code FROM sources WHERE source_id<>'src9'"""
)
cte("scan_files", "files", "generations")(
    """SELECT f.source_id, 7 AS scan_revision, canonical_path,
    CASE WHEN f.user_id%31<>0 THEN f.file_id END AS file_id,
    CASE WHEN f.user_id%29<>0 AND f.user_id%31<>0 THEN g.file_generation_id END AS file_generation_id,
    CASE WHEN f.user_id%29<>0 THEN checkpoint_revision END AS checkpoint_revision,
    observed_size AS upper_bound
    FROM files f JOIN generations g ON g.file_generation_id=f.current_generation_id
    WHERE f.user_id%19<>0"""
)
cte("pending", "facts")(
    """SELECT 'pd'||event_id AS pending_id, 'q'||event_id AS observation_id, ledger_id, session_key,
    provider, model, model_key, project_id, 'src0' AS source_id, 'g-src0-'||user_id AS file_generation_id,
    event_number*100+50 AS byte_offset, CASE WHEN k%5<>0 THEN occurred_at_ms END AS observed_at_ms,
    CASE k%4 WHEN 0 THEN 'pending' WHEN 1 THEN 'unattributed' WHEN 2 THEN 'duplicate' ELSE 'inherited' END AS kind,
    CASE k%4 WHEN 0 THEN 'ambiguous_usage' WHEN 1 THEN 'unattributed_usage' WHEN 2 THEN 'repeated_snapshot'
      ELSE 'inherited' END AS reason_code,
    CASE WHEN k%10<>9 THEN total_tokens+1 END AS vector_total
    FROM facts WHERE event_type IN ('signup','error')"""
)
cte("contexts", "facts")(
    """SELECT 'c'||event_id AS context_id, ledger_id, session_key, occurred_at_ms AS observed_at_ms,
    input_total+output_total AS context_tokens, CASE WHEN k%6<>0 THEN 4000 END AS model_context_window,
    CASE WHEN k%3=0 THEN 'pending' ELSE 'confirmed' END AS quality FROM facts WHERE input_total IS NOT NULL"""
)
cte("diagnostics", "facts")(
    """SELECT 'd'||(k%6)||':s'||user_id AS dedup_key,
    CASE WHEN k%6<3 THEN 'UNSUPPORTED_FORMAT' ELSE 'INVALID_USAGE' END AS code,
    CASE k%6 WHEN 1 THEN 'rollout-v0' WHEN 2 THEN 'rollout-v1' END AS parser_version, 'src0' AS source_id,
    'g-src0-'||user_id AS file_generation_id, event_number*100 AS byte_offset, occurred_at_ms AS seen_at_ms,
    user_id%3=0 AS resolved FROM facts WHERE event_type='error'"""
)

MEASURES = (
    "input_total",
    "cached_input",
    "noncached_input",
    "output_total",
    "reasoning_output",
    "cache_write_input",
)


def totals_columns(prefix: str = "") -> str:
    """Select list of the totals of a group of facts (alias prefix optional)."""
    p = prefix
    parts = [f"CAST(coalesce(sum({p}total_tokens),0) AS VARCHAR) AS total_tokens"]
    for m in MEASURES:
        parts.append(f"CAST(sum({p}{m}) AS VARCHAR) AS {m}")
        parts.append(
            f"CAST(coalesce(sum(CASE WHEN {p}{m} IS NOT NULL THEN {p}total_tokens END),0) AS VARCHAR) AS {m}_covered"
        )
        parts.append(f"count({p}event_id)>0 AND count({p}{m})=count({p}event_id) AS {m}_complete")
    turn = f"CASE WHEN {p}turn_id IS NOT NULL AND {p}turn_id<>'' THEN {p}session_key||'|'||{p}turn_id END"
    parts.append(f"count(DISTINCT {p}session_key) AS session_count")
    parts.append(f"count({p}event_id) AS usage_event_count")
    parts.append(f"nullif(count(DISTINCT {turn}),0) AS reliable_turn_count")
    parts.append(f"count({p}event_id)>0 AND count({turn})=count({p}event_id) AS reliable_turns_complete")
    return ", ".join(parts)
