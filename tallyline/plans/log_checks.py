"""Registered checks: log normalisation, accounting, copies and forks, manifests.

Log lines, observations and sequences are derived from the stored events, so every check
reads all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import vectors as V
from tallyline.operators import accounting, lineage, normalize
from tallyline.plans.oracle import cte, with_tables
from tallyline.plans.registry import register
from tallyline.session import cut_lineage, cut_sizes
from tallyline.sources import manifests, titles
from tallyline.sources.tables import UsageTables

# --- lines -> observations ---------------------------------------------------------------------

# Every event becomes up to four lines of its user's file, at event_number * 100 + 10 * slot.
USAGE_JSON = (
    "concat('{\"input_tokens\":', total_tokens, ',\"cached_input_tokens\":', k, ',\"output_tokens\":', user_id,"
    " ',\"total_tokens\":', total_tokens + user_id, '}')"
)
WHEN_TEXT = "date_format(timestamp_millis(occurred_at_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")"
LINES = f"""array(
named_struct('slot', 0, 'line', CASE WHEN first_of_file THEN concat('{{"timestamp":"', stamp, 'Z","type":"session_meta","payload":{{"id":"u', user_id, '","cwd":"/home/w', user_id % 7, '","model_provider":"', CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END, '"}}}}') END),
named_struct('slot', 1, 'line', CASE WHEN k % 5 = 0 THEN concat('{{"type":"turn_context","payload":{{"model":', CASE WHEN event_type = 'error' THEN 'null' ELSE concat('"', event_type, '"') END, CASE WHEN k % 2 = 0 THEN concat(',"turn_id":"t', k, '"') ELSE '' END, '}}}}') END),
named_struct('slot', 2, 'line', CASE WHEN k % 3 = 0 THEN concat('{{"type":"token_usage_record","payload":{{"thread_id":"u', user_id, '","turn_id":"t', k, '","session_id":"u', user_id, '","root_turn_id":"r","response_id":"e', event_number, '","usage":', usage, ',"thread_token_usage":', usage, ',"turn_token_usage":', usage, '}}}}') END),
named_struct('slot', 3, 'line', CASE
 WHEN k = 91 THEN concat('{{"type":"event_msg","payload":{{"type":"token_count","info":{{"last_token_usage":{{"tokens":1}}}}}}}}')
 WHEN k = 92 THEN '{{"type":'
 WHEN k = 93 THEN '{{"type":"event_msg","payload":{{"type":"agent_message"}}}}'
 WHEN k = 94 THEN '{{"type":"unheard_of"}}'
 ELSE concat('{{"timestamp":"', stamp, '+00:00","type":"event_msg","payload":{{"type":"token_count","info":{{"last_token_usage":', usage, ',"total_token_usage":', usage, ',"model_context_window":', 1000 + k, '}}}}}}') END))"""


def log_lines(spark, directory) -> DataFrame:
    # Building the lines is the costly part of this input, so it is spread by event, not by file.
    facts = UsageTables(spark, directory).facts.select(
        "event_number", "user_id", "k", "event_type", "total_tokens", "occurred_at_ms"
    ).repartition("event_number")
    firsts = facts.groupBy("user_id").agg(F.expr("min(event_number) AS first_number"))
    texts = (
        facts.join(firsts, "user_id")
        .withColumns({"first_of_file": F.expr("event_number = first_number"), "usage": F.expr(USAGE_JSON), "stamp": F.expr(
            "substring(regexp_replace(CAST(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(occurred_at_ms / CAST(1000 AS DECIMAL(10,0)) AS DECIMAL(18,6))) AS STRING), ' ', 'T'), 1, 23)"
        )})
        .select("user_id", "event_number", F.expr(f"explode({LINES}) AS e"))
        .where("e.line IS NOT NULL")
    )
    return texts.selectExpr(
        "concat('g', user_id) AS file_generation_id", "event_number * 100 + e.slot * 10 AS byte_offset",
        "event_number * 100 + e.slot * 10 + 10 AS byte_end", "e.line AS line", "false AS oversized",
    )


cte("lines", "facts0")(
    """SELECT user_id, event_number*100+slot*10 AS byte_offset, slot, k, event_type, event_number, total_tokens, occurred_at_ms,
    event_number=min(event_number) OVER (PARTITION BY user_id) AS first_of_file FROM facts0, (VALUES (0),(1),(2),(3)) s(slot)"""
)
cte("kept_lines", "lines")(
    """SELECT *, CASE WHEN slot=1 THEN event_type END AS says_model FROM lines WHERE CASE slot WHEN 0 THEN first_of_file WHEN 1 THEN k%5=0 WHEN 2 THEN k%3=0 ELSE true END"""
)
cte("carried", "kept_lines")(
    """SELECT *, last_value(CASE WHEN slot=1 THEN event_type WHEN slot=0 THEN 'error' END IGNORE NULLS) OVER w AS model_now,
    last_value(CASE WHEN slot=1 AND k%2=0 THEN 't'||k WHEN slot=0 THEN '' END IGNORE NULLS) OVER w AS turn_now,
    lag(slot) OVER (PARTITION BY user_id ORDER BY byte_offset)=2 AND lag(event_number) OVER (PARTITION BY user_id ORDER BY byte_offset)=event_number AS has_proof
    FROM kept_lines WINDOW w AS (PARTITION BY user_id ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)


@register(
    "log_observations",
    with_tables(
        """SELECT 'g'||user_id AS file_generation_id, byte_offset, CASE WHEN slot=0 THEN 'session_metadata' WHEN slot=1 THEN 'turn_metadata'
          WHEN slot=2 OR k=93 THEN 'ignored' WHEN k IN (91,92,94) THEN 'diagnostic' ELSE 'usage' END AS kind,
        CASE WHEN slot=3 THEN CASE k WHEN 91 THEN 'invalid_last_field' WHEN 92 THEN 'invalid_json_or_utf8' WHEN 94 THEN 'unsupported_record_type' END END AS reason,
        CASE WHEN NOT coalesce(slot=2 OR slot=3 AND k BETWEEN 91 AND 94,false) THEN nullif(model_now,'error') END AS model,
        CASE WHEN NOT coalesce(slot=2 OR slot=3 AND k BETWEEN 91 AND 94,false) THEN nullif(turn_now,'') END AS turn_id,
        CASE WHEN slot=3 AND k NOT BETWEEN 91 AND 94 THEN occurred_at_ms END AS event_time_ms,
        CASE WHEN slot=3 AND k NOT BETWEEN 91 AND 94 THEN total_tokens END AS input_total,
        CASE WHEN slot=3 AND k NOT BETWEEN 91 AND 94 THEN CAST(1000+k AS BIGINT) END AS model_context_window,
        CASE WHEN slot=3 AND k NOT BETWEEN 91 AND 94 AND has_proof AND turn_now='t'||k AND k<=total_tokens THEN 'e'||event_number END AS response_id
        FROM carried""",
        "carried",
    ),
)
def log_observations(spark, directory):
    rows = normalize.normalize(log_lines(spark, directory))
    return rows.selectExpr(
        "file_generation_id", "byte_offset", "kind", "reason", "model", "turn_id",
        "CASE WHEN kind = 'usage' THEN event_time_ms END AS event_time_ms", "last.input_total AS input_total",
        "model_context_window", "request_usage.response_id AS response_id",
    )


# One line a file, by event: plain, with more text, with repeated keys, closing what it did not open,
# with a second value, and with white space around.
GRAMMAR = """CASE event_number % 6
WHEN 0 THEN body WHEN 1 THEN concat(body, ' {}')
WHEN 2 THEN concat('{"type":"event_msg","payload":{"id":"lost"},', substring(replace(body, '"payload":{', '"payload":{"cwd":"/lost","id":"lost",'), 2))
WHEN 3 THEN concat(body, CASE WHEN k % 2 = 0 THEN '] {}' ELSE '} {}' END)
WHEN 4 THEN concat(body, ', {}') ELSE concat(' ', body, ' \t') END"""


@register(
    "log_grammar",
    with_tables(
        """SELECT 'j'||event_number AS file_generation_id, CASE WHEN event_number%6 IN (0,2,5) THEN 'session_metadata' ELSE 'diagnostic' END AS kind,
        CASE WHEN event_number%6 IN (1,3,4) THEN 'invalid_json_or_utf8' END AS reason, CASE WHEN event_number%6 IN (0,2,5) THEN 'codex:e'||event_number END AS session_key,
        CASE WHEN event_number%6 IN (0,2,5) THEN '/w'||k END AS cwd FROM facts0""",
        "facts0",
    ),
)
def log_grammar(spark, directory):
    body = "concat('{\"type\":\"session_meta\",\"payload\":{\"id\":\"e', event_number, '\",\"cwd\":\"/w', k, '\"},\"more\":[{\"a\":[1]}]}')"
    lines = UsageTables(spark, directory).facts.withColumn("body", F.expr(body)).selectExpr(
        "concat('j', event_number) AS file_generation_id", "0L AS byte_offset", "500L AS byte_end", f"{GRAMMAR} AS line", "false AS oversized"
    )
    return normalize.normalize(lines).select("file_generation_id", "kind", "reason", "session_key", "cwd")


@register(
    "log_projects",
    "SELECT DISTINCT 'project-'||sha256('/home/w'||(user_id%7)) AS project_id, 'w'||(user_id%7) AS display_name FROM events",
)
def log_projects(spark, directory):
    rows = normalize.normalize(log_lines(spark, directory))
    return normalize.projects_of(rows.where("kind = 'session_metadata'"))


@register(
    "log_file_sessions",
    with_tables(
        "SELECT 'g'||user_id AS file_generation_id, 'codex:u'||user_id AS session_key, min(event_number)*100 AS first_offset FROM facts0 GROUP BY user_id",
        "facts0",
    ),
)
def log_file_sessions(spark, directory):
    return normalize.file_sessions(normalize.normalize(log_lines(spark, directory)))


@register(
    "log_diagnostics",
    with_tables(
        """SELECT reason, count(*) AS occurrences, count(DISTINCT user_id) AS files FROM (SELECT user_id, CASE k WHEN 91 THEN 'invalid_last_field'
        WHEN 92 THEN 'invalid_json_or_utf8' ELSE 'unsupported_record_type' END AS reason FROM facts0 WHERE k IN (91,92,94)) GROUP BY 1""",
        "facts0",
    ),
)
def log_diagnostics(spark, directory):
    found = normalize.diagnostics_of(normalize.normalize(log_lines(spark, directory)), "rollout-v1")
    return found.groupBy("reason").agg(F.expr("count(1) AS occurrences"), F.expr("count(DISTINCT file_generation_id) AS files"))


# --- accounting ------------------------------------------------------------------------------------

PART = {"input_total": "total_tokens + k", "cached_input": "k", "output_total": "user_id + 1"}


def observations(spark, directory, key: str = "session_key") -> DataFrame:
    """One unhinted record per event; counters run per session (or per session and event type)."""
    facts = UsageTables(spark, directory).facts.withColumn("stream", F.expr(key))
    from tallyline.operators.scan import chunked_scan

    running = chunked_scan(
        facts.selectExpr("session_key", "stream", "event_number", "occurred_at_ms", "event_type", "k", *[f"CAST({e} AS BIGINT) AS d_{n}" for n, e in PART.items()]),
        ["stream"], "event_number div 100000", ["event_number"], sums={**{f"c_{n}": f"d_{n}" for n in PART}, "place": "1L"},
    )
    return running.selectExpr(
        "session_key", "event_number AS row_id", "concat('g', session_key) AS file_generation_id", "event_number * 100 AS byte_offset",
        "event_number * 100 + 100 AS byte_end", "CASE WHEN event_type <> 'error' THEN occurred_at_ms END AS event_time_ms",
        f"{V.pack(**{n: f'd_{n}' for n in PART})} AS last", f"{V.pack(**{n: f'c_{n}' for n in PART})} AS cumulative",
        "place", "k", "event_type", "stream",
    )


@register(
    "accounting_single_streams",
    with_tables(
        """SELECT session_key, method, count(*) AS records, CAST(sum(CASE WHEN method<>'unattributed_usage' THEN tokens END) AS VARCHAR) AS tokens FROM
        (SELECT session_key, total_tokens+k+user_id+1 AS tokens, CASE WHEN event_type='error' THEN 'unattributed_usage'
        WHEN event_number=min(event_number) OVER (PARTITION BY session_key) THEN 'last_new_stream' ELSE 'last_with_baseline' END AS method FROM facts)
        GROUP BY ALL""",
        "facts",
    ),
)
def accounting_single_streams(spark, directory):
    rows = observations(spark, directory).withColumn("independent_new_stream", F.expr("place = 1"))
    results = accounting.account(cut_lineage(rows))
    return results.groupBy("session_key", "method").agg(
        F.expr("count(1) AS records"), F.expr("sum(CAST(event_usage.input_total + event_usage.output_total AS DECIMAL(38,0))) AS tokens")
    )


@register(
    "accounting_hinted_streams",
    with_tables(
        """SELECT session_key, method, count(*) AS records FROM (SELECT session_key, CASE
          WHEN place=1 AND k%4=0 THEN 'unattributed_anchor' WHEN event_type='error' THEN 'unattributed_usage' WHEN place=1 THEN 'last_new_stream'
          WHEN k%4=0 THEN 'cumulative_delta' ELSE 'last_with_baseline' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY session_key, event_type
          ORDER BY event_number) AS place FROM facts)) GROUP BY ALL""",
        "facts",
    ),
)
def accounting_hinted_streams(spark, directory):
    """A stream per event type; every fourth record carries cumulative counts only."""
    rows = observations(spark, directory, "concat_ws('|', session_key, event_type)").withColumns(
        {"stream_hint": F.col("event_type"), "independent_new_stream": F.expr("place = 1"), "last": F.expr("CASE WHEN k % 4 <> 0 THEN last END")}
    )
    return accounting.account(cut_lineage(rows)).groupBy("session_key", "method").agg(F.expr("count(1) AS records"))


@register(
    "accounting_repeats_bill_nothing",
    with_tables(
        """SELECT session_key, count(*) AS events, CAST(sum(total_tokens+k+user_id+1) AS VARCHAR) AS tokens, count_if(k%3=0) AS repeats FROM facts GROUP BY 1""",
        "facts",
    ),
)
def accounting_repeats_bill_nothing(spark, directory):
    """Every third record is written twice, some bytes are read twice; neither is consumption."""
    base = observations(spark, directory).withColumns(
        {"independent_new_stream": F.expr("place = 1"), "event_time_ms": F.expr("coalesce(event_time_ms, 1L)")}
    )
    again = base.where("k % 3 = 0").withColumns(
        {"independent_new_stream": F.lit(False), "byte_offset": F.expr("byte_offset + 50"), "row_id": F.expr("row_id * 10 + 5")}
    )
    reread = base.where("k % 7 = 1").withColumns({"physical_duplicate": F.lit(True), "row_id": F.expr("row_id * 10 + 1")})
    rows = base.withColumn("row_id", F.expr("row_id * 10")).withColumn("physical_duplicate", F.lit(False))
    rows = rows.unionByName(again.withColumn("physical_duplicate", F.lit(False))).unionByName(reread.select(*rows.columns))
    results = accounting.account(cut_lineage(rows))
    return results.groupBy("session_key").agg(
        F.expr("count(event_usage) AS events"),
        F.expr("sum(CAST(event_usage.input_total + event_usage.output_total AS DECIMAL(38,0))) AS tokens"),
        F.expr("count_if(method = 'ambiguous_usage') AS repeats"),
    )


@register(
    "accounting_outputs",
    with_tables(
        """SELECT kind, reason_code, count(*) AS rows_written FROM (
          SELECT 'event' AS kind, 'last_only' AS reason_code FROM facts WHERE event_type<>'error' AND (total_tokens+k)%2=0
          UNION ALL SELECT 'unattributed', 'unattributed_usage' FROM facts WHERE event_type='error' AND (total_tokens+k)%2=0
          UNION ALL SELECT 'duplicate', 'zero_usage_excluded' FROM facts WHERE (total_tokens+k)%2=1) GROUP BY ALL""",
        "facts",
    ),
)
def accounting_outputs(spark, directory):
    """Records without cumulative counts; odd ones carry zero tokens."""
    zero = V.pack(input_total="0", output_total="0")
    rows = observations(spark, directory).withColumns(
        {
            "last": F.expr(f"CASE WHEN last.input_total % 2 = 0 THEN last ELSE {zero} END"),
            "cumulative": F.expr(f"CAST(NULL AS {V.VECTOR_TYPE})"),
        }
    )
    events, pending = accounting.split_outputs(accounting.account(cut_lineage(rows)))
    both = events.selectExpr("'event' AS kind", "calculation_method AS reason_code").unionByName(pending.select("kind", "reason_code"))
    return both.groupBy("kind", "reason_code").agg(F.expr("count(1) AS rows_written"))


@register(
    "accounting_contexts",
    with_tables(
        """SELECT session_key, count(*) AS contexts, CAST(sum(total_tokens+k+user_id+1) AS VARCHAR) AS tokens FROM facts GROUP BY 1""", "facts"
    ),
)
def accounting_contexts(spark, directory):
    rows = observations(spark, directory).withColumn("independent_new_stream", F.expr("place = 1"))
    results = accounting.account(cut_lineage(rows)).where("context_quality = 'confirmed'")
    return results.groupBy("session_key").agg(
        F.expr("count(context_tokens) AS contexts"), F.expr("sum(CAST(context_tokens AS DECIMAL(38,0))) AS tokens")
    )


# --- copies and forks ----------------------------------------------------------------------------------

cte("ranked", "facts")(
    """SELECT session_key, user_id, event_id, occurred_at_ms, row_number() OVER (PARTITION BY session_key ORDER BY event_number)-1 AS ordinal,
    count(*) OVER (PARTITION BY session_key) AS n FROM facts"""
)


def sequences(spark, directory) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three copies of each session: whole (c0), its first two thirds (c1), and one (c2) that
    goes on alone after half where the user number divides by five, else the whole again."""
    rows = observations(spark, directory).withColumn("event_time_ms", F.expr("row_id"))
    counted = rows.groupBy("session_key").agg(F.expr("count(1) AS n"))
    base = rows.join(counted, "session_key").selectExpr(
        "session_key", "n", "place - 1 AS ordinal", "event_time_ms", "last", "cumulative", "CAST(row_id AS STRING) AS signature",
        "CAST(substring(session_key, 2) AS BIGINT) AS user_id",
    )
    copies = base.select("*", F.expr("explode(array('c0', 'c1', 'c2')) AS copy")).where(
        "copy <> 'c1' OR ordinal < n * 2 div 3 OR ordinal = 0"
    )
    records = cut_sizes(
        copies.selectExpr(
            "concat(session_key, '-', copy) AS sequence_key", "ordinal", "event_time_ms", "last", "cumulative",
            "CASE WHEN copy = 'c2' AND user_id % 5 = 0 AND ordinal >= n div 2 THEN concat(signature, 'x') ELSE signature END AS signature",
        )
    )
    seqs = counted.select("*", F.expr("explode(array('c0', 'c1', 'c2')) AS copy")).selectExpr(
        "concat(session_key, '-', copy) AS sequence_key", "concat(session_key, '-', copy) AS owner_session_key", "'log' AS namespace",
        "session_key AS provider_session_id", "CASE WHEN CAST(substring(session_key, 2) AS BIGINT) % 3 <> 0 THEN 1L END AS created_at_ms",
        "CAST(NULL AS STRING) AS parent_provider_id", "true AS starts_at_head", "true AS scanned", "false AS previously_canonical",
        "copy = 'c1' AND CAST(substring(session_key, 2) AS BIGINT) % 4 = 0 AS has_trusted_history",
    )
    return cut_sizes(seqs), records, cut_sizes(lineage.proofs(records))


@register(
    "copies_common_prefix",
    with_tables(
        """SELECT session_key||'-'||copy AS sequence_key, CASE WHEN copy='c1' THEN greatest(n*2//3,1) WHEN user_id%5=0 THEN n//2 ELSE n END AS prefix
        FROM (SELECT DISTINCT session_key, user_id, n FROM ranked), (VALUES ('c1'),('c2')) t(copy)""",
        "ranked",
    ),
)
def copies_common_prefix(spark, directory):
    seqs, records, _ = sequences(spark, directory)
    pairs = seqs.where("sequence_key NOT LIKE '%-c0'").selectExpr("concat(provider_session_id, '-c0') AS reference_key", "sequence_key")
    return lineage.common_prefixes(pairs, records).select("sequence_key", "prefix")


@register(
    "copies_aligned",
    with_tables(
        """SELECT session_key||'-'||copy AS sequence_key, CASE WHEN copy='c2' AND user_id%5=0 THEN 'identity_conflict'
        WHEN user_id%3=0 AND p<2 THEN 'pending_insufficient' ELSE 'mirror' END AS decision FROM (SELECT *, CASE WHEN copy='c1' THEN greatest(n*2//3,1) ELSE n END AS p
        FROM (SELECT DISTINCT session_key, user_id, n FROM ranked), (VALUES ('c1'),('c2')) t(copy))""",
        "ranked",
    ),
)
def copies_aligned(spark, directory):
    seqs, records, proof = sequences(spark, directory)
    pairs = seqs.where("sequence_key NOT LIKE '%-c0'").selectExpr("concat(provider_session_id, '-c0') AS reference_key", "sequence_key")
    return lineage.align_mirrors(pairs, seqs, records, proof).select("sequence_key", "decision")


cte("copy_lengths", "ranked")(
    """SELECT session_key, user_id, n, greatest(n*2//3,1) AS n1 FROM (SELECT DISTINCT session_key, user_id, n FROM ranked)"""
)


@register(
    "copies_canonical_plan",
    with_tables(
        """SELECT session_key||'-'||copy AS sequence_key, CASE
          WHEN user_id%4=0 THEN CASE WHEN copy='c1' THEN 'primary' WHEN user_id%5=0 THEN 'isolated' ELSE 'member' END
          WHEN copy='c0' THEN 'primary' WHEN copy='c2' AND user_id%5=0 THEN 'isolated' ELSE 'member' END AS role
        FROM copy_lengths, (VALUES ('c0'),('c1'),('c2')) t(copy) WHERE true""",
        "copy_lengths",
    ),
)
def copies_canonical_plan(spark, directory):
    seqs, records, proof = sequences(spark, directory)
    return lineage.canonical_plan(seqs, records, proof).select("sequence_key", "role")


@register(
    "copies_counted_once",
    with_tables(
        """SELECT session_key, CASE WHEN user_id%20=0 THEN n1 ELSE n END AS counted FROM copy_lengths""",
        "copy_lengths",
    ),
)
def copies_counted_once(spark, directory):
    seqs, records, proof = sequences(spark, directory)
    plan = lineage.canonical_plan(seqs, records, proof)
    counted = lineage.canonical_records(plan, records).groupBy("group_session_key").agg(F.expr("count(1) AS counted"))
    return counted.selectExpr("split_part(group_session_key, '-', 1) AS session_key", "counted")


@register(
    "forks_inherited",
    with_tables(
        """SELECT 'f'||substring(session_key,2) AS sequence_key, CASE WHEN n//2=0 THEN 'pending_insufficient' ELSE 'inherited' END AS decision,
        n//2 AS prefix, n-n//2 AS continuation FROM copy_lengths""",
        "copy_lengths",
    ),
)
def forks_inherited(spark, directory):
    """Every session has a fork that repeats its first half and then goes its own way."""
    seqs, records, _ = sequences(spark, directory)
    parents, parent_records = seqs.where("sequence_key LIKE '%-c0'"), records.where("sequence_key LIKE '%-c0'")
    sizes = parent_records.groupBy("sequence_key").agg(F.expr("count(1) AS n"))
    fork = "concat('f', substring(split_part(sequence_key, '-', 1), 2))"
    forked = parent_records.join(sizes, "sequence_key").selectExpr(
        f"{fork} AS sequence_key", "ordinal", "event_time_ms", "last", "cumulative",
        "CASE WHEN ordinal < n div 2 THEN signature ELSE concat(signature, 'f') END AS signature",
    )
    children = parents.selectExpr(
        f"{fork} AS sequence_key", f"{fork} AS owner_session_key", "namespace", f"{fork} AS provider_session_id", "created_at_ms",
        "provider_session_id AS parent_provider_id", "true AS starts_at_head", "true AS scanned", "false AS previously_canonical", "false AS has_trusted_history",
    )
    both, all_records = cut_lineage(parents.unionByName(children)), cut_lineage(parent_records.unionByName(forked))
    return lineage.align_lineage(both, all_records, lineage.proofs(all_records)).select("sequence_key", "decision", "prefix", "continuation")


@register(
    "request_identities",
    with_tables(
        """SELECT session_key, event_number AS row_id, CASE WHEN total_tokens=first_total THEN 'duplicate' ELSE 'conflict' END AS decision FROM
        (SELECT *, first_value(total_tokens) OVER w AS first_total, row_number() OVER w AS rn FROM facts WINDOW w AS (PARTITION BY session_key, k ORDER BY event_number)) WHERE rn>1""",
        "facts",
    ),
)
def request_identities(spark, directory):
    rows = UsageTables(spark, directory).facts.selectExpr(
        "session_key", "event_number AS row_id", "'api' AS request_namespace", "CAST(k AS STRING) AS request_id",
        f"{V.pack(input_total='total_tokens', output_total='0')} AS last",
    )
    return lineage.request_identities(rows).select("session_key", "row_id", "decision")


@register(
    "cursor_decisions",
    with_tables(
        """SELECT session_key, ordinal, CASE WHEN user_id%5=0 AND ordinal>=n//2 AND ordinal<greatest(n*2//3,1) THEN 'rebuild_required'
        WHEN user_id%5=0 AND ordinal>=greatest(n*2//3,1) AND n//2<greatest(n*2//3,1) THEN 'rebuild_required'
        WHEN ordinal>=greatest(n*2//3,1) THEN 'append' ELSE 'copy' END AS decision FROM ranked""",
        "ranked",
    ),
)
def cursor_decisions(spark, directory):
    _, records, _ = sequences(spark, directory)
    named = records.withColumn("session_key", F.expr("split_part(sequence_key, '-', 1)"))
    canonical = named.where("sequence_key LIKE '%-c1'")
    incoming = named.where("sequence_key LIKE '%-c2'").withColumn("file_generation_id", F.col("sequence_key"))
    return lineage.cursor_decisions(incoming, canonical).select("session_key", "ordinal", "decision")


@register(
    "replay_levels",
    with_tables(
        """SELECT session_key, CASE WHEN a.session_key IS NULL THEN NULL WHEN parent IS NULL THEN 0 ELSE 1 END AS level FROM
        (SELECT s.session_key, p.session_key AS parent FROM sessions s LEFT JOIN sessions p ON p.session_key='s'||substring(s.parent_key,2)) a""",
        "sessions",
    ),
)
def replay_levels(spark, directory):
    edges = UsageTables(spark, directory).sessions.selectExpr("session_key", "concat('s', substring(parent_key, 2)) AS parent_key")
    return lineage.parent_levels(edges).withColumn("level", F.col("level").cast("int"))


@register(
    "dependency_closure",
    with_tables(
        """SELECT session_key FROM (SELECT session_key, CAST(substring(session_key,2) AS BIGINT) AS u FROM sessions) WHERE u//10 IN (SELECT DISTINCT
        CAST(substring(session_key,2) AS BIGINT)//10 FROM sessions WHERE session_key IN ('s7','s23'))
        UNION ALL SELECT 'm'||b FROM (VALUES (0),(20)) t(b) WHERE EXISTS (SELECT 1 FROM sessions WHERE CAST(substring(session_key,2) AS BIGINT)//10*10=b)""",
        "sessions",
    ),
)
def dependency_closure(spark, directory):
    tables = UsageTables(spark, directory)
    seeds = tables.sessions.where("session_key IN ('s7', 's23')").select("session_key")
    return lineage.dependency_closure(tables.sessions, tables.aliases, seeds).select("session_key")


@register(
    "rebuild_audit",
    with_tables(
        """SELECT session_key, count(*) AS old_events, count_if(k%5<>0) AS new_events, CAST(sum(total_tokens) AS VARCHAR) AS old_total,
        CAST(coalesce(sum(CASE WHEN k%5<>0 THEN total_tokens END),0) AS VARCHAR) AS new_total FROM facts GROUP BY 1""",
        "facts",
    ),
)
def rebuild_audit(spark, directory):
    facts = UsageTables(spark, directory).facts
    return lineage.rebuild_audit(facts, facts.where("k % 5 <> 0"))


@register(
    "rebuild_unclassified",
    with_tables(
        "SELECT event_id AS observation_id FROM facts WHERE k%9=2 OR k%9=4",
        "facts",
    ),
)
def rebuild_unclassified(spark, directory):
    """Records nobody classified (k % 9 = 2) and records classified twice (k % 9 = 4)."""
    usage = UsageTables(spark, directory).facts.selectExpr("event_id AS observation_id", "k")
    events = usage.where("k % 9 IN (0, 1, 4)")
    pending = usage.where("k % 9 > 2").withColumn("kind", F.lit("pending"))
    return lineage.unclassified(usage, events, pending).select("observation_id")


@register(
    "rebuild_manifest_changes",
    with_tables(
        """SELECT file_id, observed_size, 'gone' AS change FROM generations WHERE user_id%10=1 UNION ALL
        SELECT file_id, observed_size+1, 'new' FROM generations WHERE user_id%10=1""",
        "generations",
    ),
)
def rebuild_manifest_changes(spark, directory):
    frozen = UsageTables(spark, directory).generations.select("file_id", "observed_size")
    grown = F.expr("observed_size + CASE WHEN CAST(split_part(file_id, '-', 3) AS BIGINT) % 10 = 1 THEN 1 ELSE 0 END")
    return lineage.manifest_changes(frozen, frozen.withColumn("observed_size", grown))


@register(
    "resolved_parents",
    with_tables(
        """SELECT s.session_key, s.parent_provider_id, CASE WHEN count(DISTINCT p.session_key)=1 THEN min(p.session_key) END AS resolved_parent
        FROM sessions s LEFT JOIN sessions p ON p.provider_session_id=s.parent_provider_id GROUP BY 1, 2""",
        "sessions",
    ),
)
def resolved_parents(spark, directory):
    sessions = UsageTables(spark, directory).sessions
    return lineage.resolve_parents(sessions, sessions.where("provider_session_id IS NOT NULL"))


@register(
    "stream_frontiers",
    with_tables(
        """SELECT session_key, event_type AS stream_key, max(event_number) AS ordinal, arg_max(total_tokens, event_number) AS cumulative
        FROM facts GROUP BY 1, 2""",
        "facts",
    ),
)
def stream_frontiers(spark, directory):
    states = UsageTables(spark, directory).facts.selectExpr(
        "session_key", "event_type AS stream_key", "event_number AS ordinal", "total_tokens AS cumulative"
    )
    return lineage.stream_frontier(states)


@register(
    "proof_candidates",
    with_tables(
        """SELECT p.session_key, count(*) AS unproven FROM pending p JOIN sessions s ON s.session_key=p.session_key AND s.active_ledger_id IS NOT NULL
        WHERE kind='pending' AND CAST(substring(p.session_key,2) AS BIGINT)%2=1 GROUP BY 1""",
        "pending",
        "sessions",
    ),
)
def proof_candidates(spark, directory):
    """Even sessions were tried three times on the same evidence, odd ones not at all."""
    tables = UsageTables(spark, directory)
    none = spark.createDataFrame([], "session_key string, tries int, last_evidence string")
    every = lineage.proof_candidates(tables.sessions, tables.pending, none)
    tried = every.where("CAST(substring(session_key, 2) AS BIGINT) % 2 = 0").selectExpr("session_key", "3 AS tries", "evidence AS last_evidence")
    return lineage.proof_candidates(tables.sessions, tables.pending, tried).select("session_key", "unproven")


@register(
    "proof_jobs",
    with_tables(
        """SELECT session_key, CASE WHEN outdated THEN 'upgrade' ELSE 'unproven' END AS why, unproven FROM (
          SELECT s.session_key, u, l.parser_version<>'rollout-v1' OR l.accounting_version<>'accounting-v2' AS outdated,
            coalesce(p.before,0) AS before, coalesce(p.unproven,0) AS unproven
          FROM (SELECT *, CAST(substring(session_key,2) AS BIGINT) AS u FROM sessions) s JOIN ledgers l ON l.ledger_id=s.active_ledger_id
          LEFT JOIN (SELECT session_key, count(*) AS before, count_if(NOT (byte_offset//100%2=0 AND CAST(substring(session_key,2) AS BIGINT)%5=0)) AS unproven
            FROM pending WHERE kind='pending' GROUP BY 1) p ON p.session_key=s.session_key)
        WHERE u%10<>6 AND (outdated OR unproven>0) AND (NOT (outdated OR before>0) OR u%3=2 OR before<>unproven OR (u%3=0 AND u%9<>0))""",
        "sessions",
        "ledgers",
        "pending",
    ),
)
def proof_jobs(spark, directory):
    """Jobs after a first round: a third of the sessions succeeded, a third failed (some of them three
    times), a third was not reached; every fifth session has lost some unproven records since."""
    tables = UsageTables(spark, directory)
    user = "CAST(substring(session_key, 2) AS BIGINT)"
    mirrors = tables.sessions.where(f"{user} % 10 = 6").selectExpr("session_key AS alias_session_key")
    attempts = spark.createDataFrame([], "session_key string, job_hash string, tries int, done boolean")
    asked = lambda pending: lineage.proof_jobs(tables.sessions, mirrors, tables.ledgers, pending, attempts, "rollout-v1", "accounting-v2")
    for again in (f"{user} % 3 <> 2", f"{user} % 9 = 0", f"{user} % 9 = 0"):
        jobs = asked(tables.pending).where(again)
        attempts = cut_sizes(lineage.record_attempts(attempts, jobs, jobs.selectExpr("session_key", f"{user} % 3 = 1 AS done")))
    left = tables.pending.where(f"NOT (byte_offset div 100 % 2 = 0 AND {user} % 5 = 0)")
    return asked(left).select("session_key", "why", "unproven")


# --- manifests and titles -----------------------------------------------------------------------------------


@register(
    "manifest_file_changes",
    with_tables(
        """SELECT file_id, CASE WHEN user_id%6=1 THEN 'missing' WHEN user_id%6=2 THEN 'moved' WHEN user_id%6=3 THEN 'appended' WHEN user_id%6=4 THEN 'replaced'
        WHEN user_id%6=5 THEN 'new' ELSE 'same' END AS change FROM files""",
        "files",
    ),
)
def manifest_file_changes(spark, directory):
    tables = UsageTables(spark, directory)
    listed = tables.files.join(tables.generations.select("file_id", "observed_size"), "file_id").selectExpr(
        "source_id", "file_id AS identity", "canonical_path AS path", "observed_size AS size", "sha2(file_id, 256) AS anchors",
        "CAST(split_part(file_id, '-', 3) AS BIGINT) % 6 AS u",
    )
    before = listed.where("u <> 5").drop("u")
    after = listed.where("u <> 1").selectExpr(
        "source_id", "identity", "CASE WHEN u = 2 THEN concat(path, '.moved') ELSE path END AS path",
        "CASE WHEN u = 3 THEN size + 10 WHEN u = 4 THEN size - 1 ELSE size END AS size", "anchors", "anchors AS known_anchors",
    )
    return manifests.file_changes(before, after).selectExpr("identity AS file_id", "change")


@register(
    "session_titles",
    with_tables(
        """SELECT session_key, arg_max('t'||event_number, event_number) AS title FROM (SELECT *, max(occurred_at_ms//3600000) OVER (PARTITION BY session_key) AS latest
        FROM facts WHERE k%5<>0) WHERE occurred_at_ms//3600000=latest GROUP BY 1""",
        "facts",
    ),
)
def session_titles(spark, directory):
    """Titles by the hour they were written in; a later line wins inside one hour, blank ones never."""
    lines = UsageTables(spark, directory).facts.selectExpr(
        "event_number AS line_no",
        "concat('{\"id\":\"', session_key, '\",\"thread_name\":\"', CASE WHEN k % 5 <> 0 THEN concat('t', event_number) ELSE ' ' END,"
        " '\",\"updated_at\":\"', regexp_replace(substring(CAST(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, CAST(occurred_at_ms div 3600000 AS INT), 0, 0) AS STRING), 1, 19), ' ', 'T'), 'Z\"}') AS line",
    )
    return titles.latest_titles(lines).select("session_key", "title")
