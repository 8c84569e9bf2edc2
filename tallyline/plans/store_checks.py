"""Registered checks: rollups, valuations, catalogs, coverage, issues, quota, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import vectors as V
from tallyline.operators import calendar, catalog, coverage, pricing, quota, redact, rollup, sessions, valuation
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.plans import rates
from tallyline.plans.catalog_usage import END, IN_SPAN, SPAN, START
from tallyline.plans.filter_checks import DAY0, DAYS, GAPS_SQL, _series_sql
from tallyline.plans.oracle import cte, totals_columns, with_tables
from tallyline.plans.pricing_checks import money_sql
from tallyline.plans.registry import register
from tallyline.session import cut_lineage
from tallyline.sources.tables import UsageTables


def _stored(spark, directory):
    """Facts, rollup, turns and the ledgers whose rollup is current (every third is stale)."""
    tables = UsageTables(spark, directory)
    ready = tables.facts.where("user_id % 3 <> 0").select("ledger_id").distinct()
    return tables, rollup.build_rollup(tables.facts), rollup.build_turns(tables.facts), ready


@register("hybrid_totals", with_tables(f"SELECT {totals_columns()} FROM facts WHERE {IN_SPAN}", "facts"))
def hybrid_totals(spark, directory):
    tables, hours, turns, ready = _stored(spark, directory)
    return rollup.hybrid_totals(tables.usage(START, END), hours, turns, tables.ledgers, ready, SPAN)


@register(
    "hybrid_totals_filtered",
    with_tables(
        f"SELECT {totals_columns()} FROM facts WHERE {IN_SPAN} AND list_contains(source_ids,'src1') AND (project_id='p2' OR project_id IS NULL)",
        "facts",
    ),
)
def hybrid_totals_filtered(spark, directory):
    tables, hours, turns, ready = _stored(spark, directory)
    spec = UsageFilter(START, END, sources=Selection.of("src1"), projects=Selection.of("p2", include_unknown=True))
    return rollup.hybrid_totals(tables.usage(START, END), hours, turns, tables.ledgers, ready, spec)


@register(
    "hybrid_groups",
    with_tables(
        f"""SELECT CASE WHEN model IS NOT NULL THEN provider END AS provider, model, {totals_columns()} FROM facts
        WHERE {IN_SPAN} GROUP BY 1, 2""",
        "facts",
    ),
)
def hybrid_groups(spark, directory):
    tables, hours, turns, ready = _stored(spark, directory)
    return rollup.hybrid_totals(tables.usage(START, END), hours, turns, tables.ledgers, ready, SPAN, ["provider", "model"])


@register("hybrid_series", _series_sql(20_700_000, 86_400_000, START, END, "%Y-%m-%d"))
def hybrid_series(spark, directory):
    tables, hours, turns, ready = _stored(spark, directory)
    bins = calendar.buckets(START, END, "Asia/Kathmandu", "day")
    return rollup.hybrid_series(tables.usage(START, END), hours, turns, tables.ledgers, ready, SPAN, bins)


@register(
    "rollup_cohorts",
    with_tables(
        """SELECT ledger_id, occurred_at_ms//3600000*3600000 AS hour_start_ms, CASE WHEN model IS NOT NULL THEN provider END AS provider,
        model, project_id, array_to_string(source_ids, ',') AS sources, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens,
        CAST(sum(cached_input) AS VARCHAR) AS cached_input, count(*) AS usage_event_count, count(turn_id) AS turn_event_count
        FROM facts GROUP BY ALL""",
        "facts",
    ),
)
def rollup_cohorts(spark, directory):
    hours = rollup.build_rollup(UsageTables(spark, directory).facts)
    return hours.selectExpr(
        "ledger_id", "hour_start_ms", "provider", "model", "project_id", "replace(sources, '\\n', ',') AS sources",
        "total_tokens", "cached_input", "usage_event_count", "turn_event_count",
    )


@register(
    "rollup_turn_members",
    with_tables(
        """SELECT ledger_id, count(*) AS members FROM (SELECT DISTINCT ledger_id, occurred_at_ms//3600000 AS h, CASE WHEN model IS NOT NULL
        THEN provider END AS p, model, project_id, source_ids, turn_id FROM facts WHERE turn_id IS NOT NULL) GROUP BY 1""",
        "facts",
    ),
)
def rollup_turn_members(spark, directory):
    return rollup.build_turns(UsageTables(spark, directory).facts).groupBy("ledger_id").agg(F.expr("count(1) AS members"))


@register(
    "rollup_reconciled",
    with_tables("SELECT count(DISTINCT ledger_id) AS ledgers, CAST(0 AS BIGINT) AS differing FROM facts", "facts"),
)
def rollup_reconciled(spark, directory):
    facts = UsageTables(spark, directory).facts
    differing = rollup.rollup_differences(rollup.build_rollup(facts), facts)
    ledgers = facts.agg(F.expr("count(DISTINCT ledger_id) AS ledgers"))
    return ledgers.join(F.broadcast(differing.agg(F.expr("count(1) AS differing"))), F.lit(True))


@register(
    "rollup_stale_ledgers",
    with_tables(
        """SELECT DISTINCT ledger_id FROM facts WHERE user_id%3=0 AND total_tokens>=0
        AND ledger_id IN (SELECT ledger_id FROM facts WHERE k%7=3)""",
        "facts",
    ),
)
def rollup_stale_ledgers(spark, directory):
    """Stored sets were built before some ledgers' facts changed; exactly those are stale."""
    tables = UsageTables(spark, directory)
    before = tables.facts.where("NOT (user_id % 3 = 0 AND k % 7 = 3)")
    kept = before.unionByName(tables.facts.where("user_id % 3 = 0 AND k % 7 = 3").withColumn("total_tokens", F.expr("total_tokens + 1")))
    wanted, ready = rollup.rollup_sets(tables.facts, tables.ledgers), rollup.rollup_sets(kept, tables.ledgers)
    return rollup.stale_ledgers(wanted, ready).select("ledger_id")


@register(
    "rollup_digest_is_order_free",
    with_tables("SELECT ledger_id, true AS same FROM facts GROUP BY 1", "facts"),
)
def rollup_digest_is_order_free(spark, directory):
    facts = UsageTables(spark, directory).facts
    one = rollup.evidence_revisions(facts)
    two = rollup.evidence_revisions(facts.repartition(5, "event_id")).withColumnRenamed("evidence_revision", "again")
    return one.join(two, "ledger_id").selectExpr("ledger_id", "evidence_revision = again AS same")


# --- valuations ----------------------------------------------------------------------------


@register(
    "valuation_reuse",
    with_tables(
        """SELECT event_id, coalesce(reason,'priced') AS status, rule_id, currency, CAST(cost_atoms AS VARCHAR) AS cost_atoms,
        NOT (user_id%4=0 OR k%9=5) AS reused FROM priced""",
        "facts",
        extra=rates.priced_sql(),
    ),
)
def valuation_reuse(spark, directory):
    """Stored estimates lack some sessions, and some were made for other inputs or are contradictory."""
    facts = UsageTables(spark, directory).facts
    rules, aliases = rates.rules(spark), rates.aliases(spark)
    made = valuation.build_valuations(
        facts.where("user_id % 4 <> 0").withColumn("input_total", F.expr("CASE WHEN k % 9 = 5 THEN coalesce(input_total, 0) + 1 ELSE input_total END")),
        rules, aliases, rates.REVISION,
    )
    result = valuation.price_with_reuse(facts, made, rules, aliases, rates.REVISION)
    return result.select("event_id", "status", "rule_id", "currency", "cost_atoms", "reused")


@register(
    "valuation_contradictions",
    with_tables(
        "SELECT count(*) AS events, count_if(k%3<>1) AS trusted FROM facts",
        "facts",
    ),
)
def valuation_contradictions(spark, directory):
    facts = UsageTables(spark, directory).facts
    made = valuation.build_valuations(facts, rates.rules(spark), rates.aliases(spark), rates.REVISION)
    odd = facts.where("k % 3 = 1").select("event_id")
    other = made.join(odd, "event_id", "left_semi").withColumns(
        {"status": F.lit("overflow"), "rule_id": F.lit(None).cast("string"), "currency": F.lit(None).cast("string"),
         "cost_atoms": F.lit(None).cast("decimal(38,0)")}
    )
    trusted = valuation.reusable(made.unionByName(other.select(*made.columns)), rates.REVISION)
    counted = trusted.agg(F.expr("count(1) AS trusted"))
    return facts.agg(F.expr("count(1) AS events")).join(F.broadcast(counted), F.lit(True))


@register(
    "revalue_plan",
    with_tables(
        """SELECT ledger_id, count(*) AS event_count, user_id%2=0 AS completed FROM facts GROUP BY ledger_id, user_id
        HAVING bool_or(list_contains(source_ids,'src1'))""",
        "facts",
    ),
)
def revalue_plan(spark, directory):
    tables = UsageTables(spark, directory)
    ready = tables.facts.where("user_id % 2 = 0").select("ledger_id")
    return valuation.revalue_plan(tables.facts, tables.ledgers, ready, "sources", ("src1",))


@register(
    "revalue_progress",
    with_tables(
        """SELECT count(*) AS total_ledgers, count_if(done) AS completed_ledgers, CAST(sum(n) AS BIGINT) AS total_events,
        CAST(sum(CASE WHEN done THEN n ELSE 0 END) AS BIGINT) AS processed_events FROM
        (SELECT ledger_id, count(*) AS n, user_id%2=0 AS done FROM facts GROUP BY ledger_id, user_id)""",
        "facts",
    ),
)
def revalue_progress(spark, directory):
    tables = UsageTables(spark, directory)
    ready = tables.facts.where("user_id % 2 = 0").select("ledger_id")
    return valuation.plan_progress(valuation.revalue_plan(tables.facts, tables.ledgers, ready))


# --- catalogs --------------------------------------------------------------------------------

# Request evidence by remainder of k: which tier a response confirmed, and how it binds.
TIER = "CASE k % 6 WHEN 0 THEN 'standard' WHEN 1 THEN 'batch' WHEN 2 THEN 'flex' WHEN 3 THEN 'fast' END"


@register(
    "catalog_priced_events",
    with_tables(
        f"""SELECT event_id, CASE WHEN provider IS DISTINCT FROM 'alpha' OR model IS NULL THEN 'other'
          WHEN f.tier IS NULL THEN 'no_tier' WHEN NOT full_request THEN 'incomplete' WHEN q.model_exact IS NULL THEN 'incomplete'
          ELSE q.catalog_id||'/'||q.tier||'/'||q.context END AS outcome,
          CASE WHEN provider='alpha' AND f.tier IS NOT NULL AND full_request AND input_total IS NOT NULL AND q.model_exact IS NOT NULL
            THEN q.input_rate END AS input_rate
        FROM (SELECT *, {TIER} AS tier, k%8<>7 AS full_request, occurred_at_ms>={rates.MID} AS late FROM facts WHERE model IS NOT NULL AND model='click' AND provider='alpha') f
        LEFT JOIN catalog_quotes q ON q.model_exact=f.model AND q.tier=f.tier
          AND q.catalog_id=CASE WHEN late THEN 'text-2024-01' ELSE 'text-2023-12' END
          AND (q.context='all' OR q.context=CASE WHEN coalesce(input_total,1)*200<=272000 THEN 'short' ELSE 'long' END)""",
        "facts",
        extra=rates.catalog_values(),
    ),
)
def catalog_priced_events(spark, directory):
    """Model click of provider alpha: only the catalog knows it here, so confirmed tiers decide."""
    facts = UsageTables(spark, directory).facts.where("model = 'click' AND provider = 'alpha'")
    flat = catalog.flat_standard_rules(rates.catalogs(spark))
    selected = pricing.select_rules(facts, flat.where("introduced_revision = 2"), rates.aliases(spark), rates.REVISION)
    proven = selected.withColumns(
        {
            "actual_tier": F.expr(TIER),
            "request_input": F.expr(
                "named_struct('input_tokens', coalesce(input_total, 1L) * 200,"
                " 'binding', CASE WHEN k % 8 <> 7 THEN 'full_request' ELSE 'different_consumption' END)"
            ),
        }
    )
    chosen = catalog.with_catalog(proven.withColumn("rule", F.expr("CASE WHEN false THEN rule END")), rates.catalogs(spark), rates.REVISION)
    outcome = (
        "CASE WHEN actual_tier IS NULL THEN 'no_tier' WHEN selection IS NULL THEN 'incomplete'"
        " ELSE concat_ws('/', reference_catalog_id, actual_tier, quote_context) END AS outcome"
    )
    return chosen.selectExpr(
        "event_id", outcome, "CAST(CASE WHEN selection = 'request' AND input_total IS NOT NULL THEN rule.input_rate_atoms END AS INT) AS input_rate"
    )


@register(
    "catalog_quotes_as_of",
    with_tables(
        f"""SELECT f.event_id, q.catalog_id, CAST(count(q.tier) AS BIGINT) AS quotes FROM facts f LEFT JOIN catalog_quotes q
        ON q.model_exact=f.model AND q.catalog_id=CASE WHEN f.occurred_at_ms>={rates.MID} THEN 'text-2024-01' ELSE 'text-2023-12' END
        WHERE f.provider='alpha' AND f.model IS NOT NULL GROUP BY ALL""",
        "facts",
        extra=rates.catalog_values(),
    ),
)
def catalog_quotes_as_of(spark, directory):
    """Which catalog speaks for an event's model at its time; a dropped model has none."""
    facts = UsageTables(spark, directory).facts.where("provider = 'alpha' AND model IS NOT NULL")
    table = catalog.publication_models(rates.catalogs(spark), rates.REVISION)
    versions = table.select("pub_provider", "pub_model", "verified_at_ms", "until_ms", "catalog_id", F.size("quotes").cast("long").alias("quotes"))
    joined = facts.join(
        F.broadcast(versions),  # a catalog holds at most 1024 quotes
        F.expr(
            "provider = pub_provider AND model = pub_model AND verified_at_ms <= occurred_at_ms"
            " AND (until_ms IS NULL OR occurred_at_ms < until_ms)"
        ),
        "left",
    )
    return joined.selectExpr("event_id", "catalog_id", "coalesce(quotes, 0L) AS quotes")


# --- coverage -----------------------------------------------------------------------------------

BAD = """(e.file_generation_id IS NULL OR g.file_generation_id IS NULL OR g.state<>'current' OR f.current_generation_id IS DISTINCT FROM e.file_generation_id
OR f.source_id IS DISTINCT FROM e.source_id OR f.canonical_path IS DISTINCT FROM e.canonical_path OR g.checkpoint_revision IS DISTINCT FROM e.checkpoint_revision
OR g.observed_size IS DISTINCT FROM e.upper_bound OR g.committed_offset IS DISTINCT FROM e.upper_bound)"""
BAD_FROM = "scan_files e LEFT JOIN files f ON f.file_id=e.file_id LEFT JOIN generations g ON g.file_generation_id=e.file_generation_id"
cte("pending_files", "scan_files", "scan_state", "sources")(
    f"""SELECT f.source_id, 'file:'||f.file_id AS identity FROM files f LEFT JOIN generations g ON g.file_generation_id=f.current_generation_id
    WHERE g.file_generation_id IS NULL OR g.state<>'current' OR g.committed_offset<g.observed_size OR f.status NOT IN ('present','known')
    UNION SELECT e.source_id, CASE WHEN e.file_id IS NULL THEN 'path:'||e.canonical_path ELSE 'file:'||e.file_id END FROM {BAD_FROM} WHERE {BAD}"""
)


def _files(tables):
    return tables.files, tables.generations, tables.scan_files, tables.scan_state, tables.sources


@register("coverage_pending_files", with_tables("SELECT source_id, identity FROM pending_files", "pending_files"))
def coverage_pending_files(spark, directory):
    return coverage.pending_file_identities(*_files(UsageTables(spark, directory)))


@register(
    "coverage_bad_entries",
    with_tables(f"SELECT e.source_id, e.canonical_path FROM {BAD_FROM} WHERE {BAD}", "pending_files"),
)
def coverage_bad_entries(spark, directory):
    tables = UsageTables(spark, directory)
    return coverage.bad_scan_entries(tables.scan_files, tables.files, tables.generations).select("source_id", "canonical_path")


SOURCE_ISSUES = f"""SELECT s.source_id, CASE WHEN NOT enabled THEN 'source_paused' WHEN readability='partially_readable' THEN 'source_partially_readable'
WHEN ss.source_id IS NULL THEN 'scan_evidence_missing' WHEN EXISTS (SELECT 1 FROM {BAD_FROM} WHERE e.source_id=s.source_id AND {BAD}) THEN 'source_scan_pending'
WHEN ss.state<>'ready' THEN 'source_scan_incomplete' END AS code, last_success_ms FROM sources s LEFT JOIN scan_state ss ON ss.source_id=s.source_id"""


@register("coverage_source_issues", with_tables(SOURCE_ISSUES, "pending_files"))
def coverage_source_issues(spark, directory):
    files, generations, scan_files, scan_state, sources = _files(UsageTables(spark, directory))
    issues = coverage.source_issues(sources, scan_state, scan_files, files, generations)
    return issues.select("source_id", "code", "last_success_ms")


def _coverage(tables, spec):
    files, generations, scan_files, scan_state, sources = _files(tables)
    from tallyline.operators import filters

    merged = coverage.deduplicated_diagnostics(tables.diagnostics)
    return coverage.coverage(
        coverage.gap_counts(filters.apply_pending_filter(tables.pending, spec, tables.aliases)),
        coverage.pending_file_identities(files, generations, scan_files, scan_state, sources, spec.sources),
        coverage.source_issues(sources, scan_state, scan_files, files, generations, spec.sources),
        coverage.format_issues(merged, spec.sources),
    )


@register(
    "coverage_of_range",
    with_tables(
        f"""SELECT 'partial' AS state, count_if(kind='pending') AS pending_observation_count,
        count_if(kind='unattributed') AS unattributed_observation_count,
        CASE WHEN count_if(kind='unattributed' AND vector_total IS NULL)=0 THEN CAST(sum(CASE WHEN kind='unattributed' THEN vector_total END) AS VARCHAR) END AS unattributed_total_tokens,
        (SELECT count(*) FROM pending_files) AS pending_file_count,
        (SELECT string_agg(source_id||'='||code, ',' ORDER BY source_id) FROM ({SOURCE_ISSUES}) WHERE code IS NOT NULL) AS source_issues,
        (SELECT string_agg(f||'='||n, ',' ORDER BY f) FROM (SELECT coalesce(parser_version,'unknown') AS f, count(*) AS n FROM diagnostics
          WHERE code='UNSUPPORTED_FORMAT' AND NOT resolved GROUP BY 1)) AS format_issues
        FROM pending WHERE observed_at_ms IS NULL OR observed_at_ms>={START} AND observed_at_ms<{END}""",
        "pending",
        "pending_files",
        "diagnostics",
    ),
)
def coverage_of_range(spark, directory):
    row = _coverage(UsageTables(spark, directory), SPAN)
    return row.selectExpr(
        "state", "pending_observation_count", "unattributed_observation_count", "unattributed_total_tokens", "pending_file_count",
        "concat_ws(',', source_issues) AS source_issues", "concat_ws(',', format_issues) AS format_issues",
    )


@register(
    "coverage_gap_series_states",
    with_tables(f"SELECT bucket_index, 'partial' AS state FROM ({GAPS_SQL})", "pending"),
)
def coverage_gap_series_states(spark, directory):
    tables = UsageTables(spark, directory)
    bins = calendar.buckets(DAY0, DAY0 + DAYS * 86_400_000, "UTC", "day")
    base = _coverage(tables, UsageFilter(DAY0, DAY0 + DAYS * 86_400_000))
    return coverage.series_state(coverage.gap_series(tables.pending, bins), base)


@register(
    "scan_readiness",
    with_tables(
        f"""SELECT source_id, scan_revision, CASE WHEN EXISTS (SELECT 1 FROM {BAD_FROM} WHERE e.source_id=s.source_id AND {BAD})
        THEN 'incomplete' ELSE 'ready' END AS state FROM scan_state s""",
        "pending_files",
    ),
)
def scan_readiness(spark, directory):
    tables = UsageTables(spark, directory)
    ready = coverage.scan_ready(tables.scan_state, tables.scan_files, tables.files, tables.generations)
    return ready.withColumn("scan_revision", F.col("scan_revision").cast("int"))


@register(
    "files_missing_after_scan",
    with_tables(
        """SELECT file_id, CASE WHEN EXISTS (SELECT 1 FROM scan_files e WHERE e.file_id=f.file_id) THEN 'present' ELSE 'missing' END AS status
        FROM files f""",
        "files",
        "scan_files",
    ),
)
def files_missing_after_scan(spark, directory):
    tables = UsageTables(spark, directory)
    return coverage.mark_missing(tables.files, tables.scan_files, tables.scan_state).select("file_id", "status")


@register(
    "source_readability",
    with_tables(
        """SELECT source_id, CASE WHEN bool_or(k%2=0) AND bool_or(k%2=1) THEN 'partially_readable' WHEN bool_or(k%2=0) THEN 'readable'
        ELSE 'unreadable' END AS readability FROM (SELECT session_key AS source_id, k FROM facts) GROUP BY 1""",
        "facts",
    ),
)
def source_readability(spark, directory):
    trees = UsageTables(spark, directory).facts.selectExpr(
        "session_key AS source_id", "CASE WHEN k % 2 = 0 THEN 'readable' ELSE 'entry_unreadable' END AS outcome"
    )
    return coverage.readability(trees)


@register(
    "diagnostics_merged",
    with_tables(
        """SELECT dedup_key, count(*) AS occurrences, min(seen_at_ms) AS first_seen_at_ms, max(seen_at_ms) AS last_seen_at_ms,
        arg_max(code, byte_offset) AS code FROM diagnostics GROUP BY 1""",
        "diagnostics",
    ),
)
def diagnostics_merged(spark, directory):
    merged = coverage.deduplicated_diagnostics(UsageTables(spark, directory).diagnostics)
    return merged.select("dedup_key", "occurrences", "first_seen_at_ms", "last_seen_at_ms", "code")


cte("issues", "diagnostics", "pending", "files")(
    """SELECT 'diagnostic' AS origin, dedup_key AS identity, m.source_id AS source, 'log_record' AS kind, code, canonical_path AS path,
      byte_offset, seen AS sort_time FROM (SELECT dedup_key, max(source_id) AS source_id, arg_max(code,byte_offset) AS code, arg_max(file_generation_id,byte_offset) AS g,
        max(byte_offset) AS byte_offset, max(seen_at_ms) AS seen, bool_or(resolved) AS resolved FROM diagnostics GROUP BY 1) m
      JOIN files f ON f.current_generation_id=m.g WHERE NOT resolved
    UNION ALL SELECT 'usage', pending_id, f.source_id, CASE kind WHEN 'pending' THEN 'unconfirmed_usage' ELSE 'unattributed_usage' END, NULL,
      canonical_path, byte_offset, observed_at_ms FROM pending p JOIN files f ON f.current_generation_id=p.file_generation_id WHERE kind IN ('pending','unattributed')
    UNION ALL SELECT 'file', file_id, source_id, 'missing_file', NULL, canonical_path, NULL, NULL FROM files WHERE status='missing'"""
)


def _issues(tables):
    merged = coverage.deduplicated_diagnostics(tables.diagnostics)
    return coverage.issue_rows(merged, tables.pending, tables.files, tables.scan_state, tables.sources)


ISSUE_RANK = """SELECT *, row_number() OVER (PARTITION BY source, kind, code, path ORDER BY sort_time DESC NULLS LAST, identity) AS rn FROM issues"""


@register(
    "issues_newest",
    with_tables(f"SELECT origin, identity, source, kind, code, path, byte_offset, sort_time FROM ({ISSUE_RANK}) WHERE rn=1", "issues"),
)
def issues_newest(spark, directory):
    return coverage.newest_issues(_issues(UsageTables(spark, directory)))


@register(
    "issues_page",
    with_tables(
        f"""SELECT origin, identity, sha256(origin||':'||identity) AS issue_id FROM ({ISSUE_RANK}) WHERE rn=1
        ORDER BY sort_time DESC NULLS LAST, origin, identity LIMIT 21""",
        "issues",
    ),
)
def issues_page(spark, directory):
    return coverage.issue_list(_issues(UsageTables(spark, directory))).select("origin", "identity", "issue_id")


# --- quota ----------------------------------------------------------------------------------------

WINDOW = """concat('{"usedPercent":', total_tokens % 130, ',"windowDurationMins":', CASE WHEN k % 3 = 0 THEN 10080 ELSE 300 END, ',"resetsAt":', 1704000000 + event_number, '}')"""
SECOND = """concat('{"usedPercent":', k, ',"windowDurationMins":', CASE WHEN k % 5 = 0 THEN 300 ELSE 60 END, '}')"""
READING = f"""CASE event_type
WHEN 'view' THEN concat('{{"rateLimitsByLimitId":{{"codex":{{"limitId":"codex","primary":', {WINDOW}, ',"secondary":', {SECOND}, '}},"b":{{"primary":', {SECOND}, '}}}}}}')
WHEN 'purchase' THEN concat('{{"rateLimits":{{"primary":', {WINDOW}, '}}}}')
WHEN 'click' THEN concat('{{"rateLimits":{{"limitId":"b","limitName":"Big","secondary":', {WINDOW}, '}}}}')
WHEN 'signup' THEN '{{"rateLimitsByLimitId":{{"x":{{"limitId":"y"}}}}}}'
ELSE concat('{{"rateLimits":{{"secondary":', {SECOND}, '}}}}') END"""


def readings(spark, directory):
    return UsageTables(spark, directory).facts.selectExpr(
        "session_key AS account", "event_number AS seq", "occurred_at_ms AS at_ms", "event_type IN ('view', 'purchase') AS is_read",
        f"{READING} AS reading",
    )


cte("limits", "facts")(
    """SELECT session_key AS account, event_number AS seq, occurred_at_ms AS at_ms, kind, limit_id, legacy, event_type, total_tokens, k FROM facts f JOIN (VALUES
    ('view','replace','codex',false),('view','replace','b',false),('purchase','replace','legacy',true),('click','limit','b',false),
    ('error','unidentified','legacy',true)) t(et, kind, limit_id, legacy) ON et=event_type"""
)
cte("book", "limits")(
    """SELECT l.* FROM limits l JOIN (SELECT b.account, greatest(full_seq, (SELECT max(seq) FROM limits u WHERE u.account=b.account AND u.kind='unidentified'
        AND u.seq>full_seq AND full_legacy AND NOT EXISTS (SELECT 1 FROM limits n WHERE n.account=b.account AND n.kind='limit' AND n.seq>full_seq AND n.seq<u.seq))) AS base
      FROM (SELECT account, max(seq) AS full_seq, arg_max(legacy, seq) AS full_legacy FROM limits WHERE kind='replace' GROUP BY account) b) x ON x.account=l.account
    WHERE l.seq=base OR (l.kind='limit' AND l.seq>base AND l.seq=(SELECT max(seq) FROM limits z WHERE z.account=l.account AND z.kind='limit'))"""
)


@register(
    "quota_limits",
    with_tables("SELECT account, seq, at_ms, kind, limit_id, legacy AS legacy_identity FROM limits", "limits"),
)
def quota_limits(spark, directory):
    return quota.parse_readings(readings(spark, directory)).select("account", "seq", "at_ms", "kind", "limit_id", "legacy_identity")


@register(
    "quota_windows",
    with_tables(
        """SELECT account, seq, limit_id, 'primary' AS window_id, CAST(total_tokens%130 AS DOUBLE) AS used_percent,
        CAST(greatest(least(100-total_tokens%130,100),0) AS DOUBLE) AS remaining_percent, CASE WHEN k%3=0 THEN '周额度' ELSE '5 小时额度' END AS period,
        greatest(least(100-total_tokens%130,100),0)<=20 AS low FROM limits WHERE (event_type='view' AND limit_id='codex') OR event_type='purchase'""",
        "limits",
    ),
)
def quota_windows(spark, directory):
    rows = quota.window_rows(quota.parse_readings(readings(spark, directory)), 1_704_000_000_000)
    wanted = rows.where("window_id = 'primary' AND duration_mins IN (300, 10080) AND limit_id IN ('codex', 'legacy')")
    return wanted.select("account", "seq", "limit_id", "window_id", "used_percent", "remaining_percent", "period", "low")


@register(
    "quota_book",
    with_tables("""SELECT b.account, limit_id, seq, 1706700000000-at_ms>=300000 AS stale FROM book b
        WHERE NOT EXISTS (SELECT 1 FROM book c WHERE c.account=b.account AND c.limit_id=b.limit_id AND c.seq>b.seq)""", "book"),
)
def quota_book(spark, directory):
    book = quota.current_book(quota.parse_readings(readings(spark, directory)))
    return quota.with_staleness(book, 1_706_700_000_000).select("account", "limit_id", "seq", "stale")


@register(
    "quota_selected_limit",
    with_tables(
        """SELECT account, CASE WHEN bool_or(limit_id='codex') THEN 'codex' WHEN count(DISTINCT limit_id)=1 THEN min(limit_id) END AS limit_id FROM book GROUP BY 1""",
        "book",
    ),
)
def quota_selected_limit(spark, directory):
    return quota.selected_limit(quota.current_book(quota.parse_readings(readings(spark, directory))))


@register(
    "quota_roles",
    with_tables(
        """SELECT account, seq, limit_id, CASE WHEN k%3=0 THEN 10080 END AS weekly_mins,
        CASE WHEN k%5=0 AND k%3<>0 THEN NULL WHEN k%5=0 THEN 300 ELSE 60 END AS shortest_mins FROM limits WHERE event_type='view' AND limit_id='codex'""",
        "limits",
    ),
)
def quota_roles(spark, directory):
    rows = quota.with_roles(quota.parse_readings(readings(spark, directory))).where("limit_id = 'codex'")
    return rows.selectExpr(
        "account", "seq", "limit_id", "CAST(weekly.duration_mins AS INT) AS weekly_mins", "CAST(shortest.duration_mins AS INT) AS shortest_mins"
    )


@register(
    "quota_countdowns",
    with_tables(
        """SELECT event_id, CASE WHEN r<=0 THEN '等待额度更新' WHEN m>=1440 THEN (m//1440)||'天 '||(m%1440//60)||'小时'
        WHEN m>=60 THEN (m//60)||'小时 '||(m%60)||'分钟' ELSE m||'分钟' END AS resets_in FROM
        (SELECT event_id, occurred_at_ms-1705000000000 AS r, (occurred_at_ms-1705000000000+59999)//60000 AS m FROM facts)""",
        "facts",
    ),
)
def quota_countdowns(spark, directory):
    return UsageTables(spark, directory).facts.selectExpr("event_id", f"{quota.countdown('occurred_at_ms', '1705000000000L')} AS resets_in")


# --- redaction ---------------------------------------------------------------------------------------

ALIAS_SQL = "'{0} #'||substring(sha256({1}),1,12)"


@register(
    "redacted_sessions",
    with_tables(
        f"""SELECT session_key, {ALIAS_SQL.format('会话', 'session_key')} AS display_name,
        CASE WHEN parent_provider_id IS NOT NULL THEN '父会话（已隐藏）' END AS parent_provider_id FROM sessions""",
        "sessions",
    ),
)
def redacted_sessions(spark, directory):
    rows = UsageTables(spark, directory).sessions.selectExpr("session_key", "coalesce(provider_session_id, session_key) AS display_name", "parent_provider_id")
    return redact.redact_sessions(rows).select("session_key", "display_name", "parent_provider_id")


@register(
    "redacted_events",
    with_tables(
        f"""SELECT event_id, {ALIAS_SQL.format('会话', 'session_key')} AS session_display_name,
        CASE WHEN project_id IS NOT NULL THEN {ALIAS_SQL.format('项目', 'project_id')} END AS project_display_name,
        CAST(NULL AS VARCHAR) AS cost_atoms, total_tokens, true AS redacted FROM facts""",
        "facts",
    ),
)
def redacted_events(spark, directory):
    facts = UsageTables(spark, directory).facts.selectExpr(
        "event_id", "session_key", "session_key AS session_display_name", "project_id", "project_id AS project_display_name",
        "CAST(total_tokens AS DECIMAL(38,0)) AS cost_atoms", "total_tokens",
    )
    return redact.redact_events(facts).select("event_id", "session_display_name", "project_display_name", "cost_atoms", "total_tokens", "redacted")


@register(
    "redacted_groups",
    with_tables(
        f"""SELECT project_id AS dimension_key, CASE WHEN project_id IS NULL THEN '未知项目' ELSE {ALIAS_SQL.format('项目', 'project_id')} END AS label,
        count(*) AS amount FROM facts GROUP BY 1""",
        "facts",
    ),
)
def redacted_groups(spark, directory):
    from tallyline.operators import facets

    tables = UsageTables(spark, directory)
    return redact.redact_options(facets.project_options(tables.facts, tables.projects), "projects")


@register(
    "redacted_issues",
    with_tables("SELECT identity, byte_offset, CAST(NULL AS VARCHAR) AS path FROM issues", "issues"),
)
def redacted_issues(spark, directory):
    return redact.redact_issues(_issues(UsageTables(spark, directory))).select("identity", "byte_offset", "path")
