"""Registered checks: the composite answers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyline.operators import catalog, pricing
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.plans import answers, rates, store_checks  # noqa: F401  (its SQL twins are used below)
from tallyline.plans.catalog_usage import END, IN_SPAN, SPAN, START
from tallyline.plans.filter_checks import CHILD_SQL, DAY0, LATEST_SQL
from tallyline.plans.oracle import with_tables
from tallyline.plans.pricing_checks import money_sql
from tallyline.plans.registry import register
from tallyline.sources.tables import StoredTables, UsageTables

IN_F = IN_SPAN.replace("occurred_at_ms", "f.occurred_at_ms")
COSTS = "concat_ws(';', transform(currencies, c -> concat(c.currency, ' ', c.estimated_cost))) AS costs"
REASONS = "concat_ws(';', transform(reasons, r -> concat(r.code, ' ', r.total_tokens, ' ', r.event_count))) AS reasons"


def costs_sql(group: str, where: str = "true") -> str:
    return f"""coalesce((SELECT string_agg(c.currency||' '||c.cost, ';' ORDER BY c.currency) FROM (SELECT currency, {money_sql('sum(q.cost_atoms)')} AS cost
    FROM priced q WHERE q.reason IS NULL AND {group} AND {where} GROUP BY currency) c), '')"""


REASONS_SQL = """coalesce((SELECT string_agg(c.reason||' '||c.t||' '||c.n, ';' ORDER BY c.reason) FROM
(SELECT reason, sum(total_tokens) AS t, count(*) AS n FROM priced WHERE reason IS NOT NULL GROUP BY reason) c), '')"""


def model_of(spark, directory) -> answers.Model:
    return answers.Model.of(StoredTables(spark, directory), rates.rules(spark), rates.aliases(spark), rates.REVISION)


HEADER_SQL = f"""SELECT CAST(sum(total_tokens) AS VARCHAR) AS total_tokens, count(*) AS usage_event_count, count(DISTINCT session_key) AS session_count,
CAST(sum(CASE WHEN reason IS NULL THEN total_tokens END) AS VARCHAR) AS priced_total_tokens, {costs_sql('true')} AS costs, {REASONS_SQL} AS reasons,
'partial' AS state, (SELECT count(*) FROM pending p WHERE p.kind='pending' AND (p.observed_at_ms IS NULL OR p.observed_at_ms>={START} AND p.observed_at_ms<{END})) AS pending_observation_count,
(SELECT count(*) FROM pending_files) AS pending_file_count, false AS breakdown_complete FROM priced"""


def _header(row):
    return row.selectExpr(
        "total_tokens", "usage_event_count", "session_count", "priced_total_tokens", COSTS, REASONS, "state", "pending_observation_count",
        "pending_file_count", "breakdown_complete",
    )


@register("answer_header", with_tables(HEADER_SQL, "facts", "pending", "pending_files", extra=rates.priced_sql(IN_F)))
def answer_header(spark, directory):
    return _header(answers.header(answers.Answer(model_of(spark, directory), SPAN)))


@register(
    "answer_dashboard_recent",
    with_tables(
        f"""SELECT session_key, latest_at_ms, l.latest_model, l.latest_project_id, coalesce(s.provider_session_id, session_key) AS display_name,
        CAST(total AS VARCHAR) AS total_tokens, {costs_sql('q.session_key=r.session_key')} AS costs
        FROM (SELECT session_key, max(occurred_at_ms) AS latest_at_ms, sum(total_tokens) AS total FROM facts WHERE {IN_SPAN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) r
        JOIN ({LATEST_SQL.replace('FROM facts', f'FROM facts WHERE {IN_SPAN}')}) l USING (session_key) JOIN sessions s USING (session_key)""",
        "facts",
        "sessions",
        extra=rates.priced_sql(IN_F),
    ),
)
def answer_dashboard_recent(spark, directory):
    parts = answers.dashboard(model_of(spark, directory), SPAN, "day", (DAY0, END))
    return parts["recent_sessions"].selectExpr("session_key", "latest_at_ms", "latest_model", "latest_project_id", "display_name", "total_tokens", COSTS)


@register(
    "answer_dashboard_heatmap",
    with_tables(
        f"""SELECT bucket_index, CAST(total AS VARCHAR) AS total_tokens, 'partial' AS state,
        CASE WHEN total=0 THEN 0 ELSE CAST((total*3+max(total) OVER ()-1)//max(total) OVER () AS INTEGER) END AS heat_level FROM
        (SELECT CAST(i AS INTEGER) AS bucket_index, coalesce(sum(total_tokens),0) AS total FROM range({-(-(END - DAY0) // 86_400_000)}) t(i) LEFT JOIN facts
        ON occurred_at_ms>={DAY0}+i*86400000 AND occurred_at_ms<least({END},{DAY0}+(i+1)*86400000) GROUP BY i)""",
        "facts",
    ),
)
def answer_dashboard_heatmap(spark, directory):
    parts = answers.dashboard(model_of(spark, directory), SPAN, "day", (DAY0, END))
    return parts["heatmap"].select("bucket_index", "total_tokens", "state", "heat_level")


@register(
    "answer_groups_projects",
    with_tables(
        f"""SELECT project_id AS dimension_key, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens,
        CAST(coalesce(sum(CASE WHEN reason IS NOT NULL THEN total_tokens END),0) AS VARCHAR) AS unpriced_total_tokens,
        {costs_sql('q.project_id IS NOT DISTINCT FROM p.project_id')} AS costs, 'partial' AS state,
        (SELECT nullif(count(*),0) FROM pending g WHERE g.kind='pending' AND g.project_id IS NOT DISTINCT FROM p.project_id AND (g.observed_at_ms IS NULL OR
          g.observed_at_ms>={START} AND g.observed_at_ms<{END})) AS pending_observation_count FROM priced p GROUP BY project_id""",
        "facts",
        "pending",
        extra=rates.priced_sql(IN_F),
    ),
)
def answer_groups_projects(spark, directory):
    rows = answers.grouped(model_of(spark, directory), SPAN, "projects", "total_desc", 200)["groups"]
    return rows.selectExpr(
        "dimension_key", "total_tokens", "unpriced_total_tokens", COSTS, "state", "nullif(pending_observation_count, 0L) AS pending_observation_count"
    )


@register(
    "answer_facet_projects",
    with_tables(
        f"SELECT project_id AS dimension_key, count(*) AS amount FROM facts WHERE {IN_SPAN} AND list_contains(source_ids,'src1') AND project_id>'p1' GROUP BY 1 ORDER BY 1 LIMIT 4",
        "facts",
    ),
)
def answer_facet_projects(spark, directory):
    spec = UsageFilter(START, END, projects=Selection.of("p5"), sources=Selection.of("src1"))
    return answers.facet(model_of(spark, directory), spec, "projects", "", 3, "p1").select("dimension_key", "amount")


@register(
    "answer_sessions_page",
    with_tables(
        f"""SELECT session_key, CAST(total AS VARCHAR) AS total_tokens, p.parent_key, coalesce(c.n,0) AS child_count, x.context_tokens,
        {costs_sql('q.session_key=r.session_key')} AS costs FROM (SELECT session_key, sum(total_tokens) AS total FROM facts WHERE {IN_SPAN} GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 26) r
        LEFT JOIN (SELECT s.session_key, y.session_key AS parent_key FROM sessions s LEFT JOIN aliases a ON a.alias_session_key=s.parent_key
          LEFT JOIN sessions y ON y.session_key=coalesce(a.canonical_session_key,s.parent_key) AND y.active_ledger_id IS NOT NULL) p USING (session_key)
        LEFT JOIN (SELECT session_key, count(*) AS n FROM ({CHILD_SQL}) GROUP BY 1) c USING (session_key)
        LEFT JOIN (SELECT session_key, context_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY observed_at_ms DESC, context_id) AS rn
          FROM contexts) WHERE rn=1) x USING (session_key)""",
        "facts",
        "sessions",
        "aliases",
        "contexts",
        extra=rates.priced_sql(IN_F),
    ),
)
def answer_sessions_page(spark, directory):
    rows = answers.sessions_page(model_of(spark, directory), SPAN, "total_desc", 25)["sessions"]
    return rows.selectExpr("session_key", "total_tokens", "parent_key", "child_count", "context_tokens", COSTS)


@register(
    "answer_session_children",
    with_tables(f"SELECT child_key FROM ({CHILD_SQL}) WHERE session_key='s20' ORDER BY 1 LIMIT 100", "sessions", "aliases"),
)
def answer_session_children(spark, directory):
    return answers.session_detail(model_of(spark, directory), SPAN, "m20")["children"]


@register(
    "answer_session_classifications",
    with_tables("SELECT kind, reason_code, count(DISTINCT observation_id) AS observation_count FROM pending WHERE session_key='s20' GROUP BY ALL", "pending"),
)
def answer_session_classifications(spark, directory):
    return answers.session_detail(model_of(spark, directory), SPAN, "m20")["classifications"]


@register(
    "answer_turns_page",
    with_tables(
        f"""SELECT turn_id, first_at_ms, last_at_ms, CAST(total AS VARCHAR) AS total_tokens, {costs_sql("q.turn_id=r.turn_id AND q.session_key='s20'")} AS costs FROM
        (SELECT turn_id, min(occurred_at_ms) AS first_at_ms, max(occurred_at_ms) AS last_at_ms, sum(total_tokens) AS total FROM facts WHERE {IN_SPAN}
         AND session_key='s20' AND turn_id IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 21) r""",
        "facts",
        extra=rates.priced_sql(IN_F),
    ),
)
def answer_turns_page(spark, directory):
    rows = answers.turns_page(model_of(spark, directory), SPAN, "m20", 20)["turns"]
    return rows.selectExpr("turn_id", "first_at_ms", "last_at_ms", "total_tokens", COSTS)


@register(
    "answer_events_page",
    with_tables(
        f"""SELECT e.event_id, coalesce(s.provider_session_id,e.session_key) AS session_display_name, coalesce(p.user_alias,p.display_name) AS project_display_name,
        CAST(e.cost_atoms AS VARCHAR) AS cost_atoms, e.reason FROM (SELECT * FROM priced ORDER BY occurred_at_ms DESC, event_id LIMIT 101) e
        JOIN sessions s ON s.session_key=e.session_key LEFT JOIN projects p ON p.project_id=e.project_id""",
        "facts",
        "sessions",
        "projects",
        extra=rates.priced_sql(IN_F),
    ),
)
def answer_events_page(spark, directory):
    rows = answers.events_page(model_of(spark, directory), SPAN, "time_desc", 100)["events"]
    return rows.select("event_id", "session_display_name", "project_display_name", "cost_atoms", "reason")


# What responses proved, by remainders of k: the tier, whether it binds the whole request, and its size.
EVIDENCE_SQL = f"""(SELECT *, {store_checks.TIER} AS tier, k%8<>7 AS full_request, CASE WHEN coalesce(input_total,1)*200<=272000 THEN 'short' ELSE 'long' END AS band FROM facts)"""


def priced_by_catalogs(spark, directory) -> answers.Model:
    tables = StoredTables(spark, directory)
    documents = rates.catalogs(spark)
    table = catalog.published_rules(rates.rules(spark, rates.BESIDE_CATALOGS), documents, (1, 2))
    model = answers.Model.of(tables, table, rates.aliases(spark), rates.REVISION, documents)
    binding = "CASE WHEN k % 8 <> 7 THEN 'full_request' ELSE 'different_consumption' END"
    proofs = {
        "actual_tier": F.expr(store_checks.TIER),
        "request_input": F.expr(f"named_struct('input_tokens', coalesce(input_total, 1L) * 200, 'binding', {binding})"),
    }
    return replace(model, usage=lambda start, end: tables.usage(start, end).withColumns(proofs))


@register(
    "answer_events_catalog",
    with_tables(
        """SELECT event_id, matched_kind, matched_rule_id, reason, currency, CAST(cost_atoms AS VARCHAR) AS cost_atoms, coalesce(input_total,1)*200 AS request_input_tokens
        FROM priced ORDER BY occurred_at_ms DESC, event_id LIMIT 101""",
        "facts",
        extra="evident AS " + EVIDENCE_SQL + ", " + rates.catalog_priced_sql(IN_F).replace("FROM facts f", "FROM evident f"),
    ),
)
def answer_events_catalog(spark, directory):
    """Events with the rule or catalog quote that decided, and the request it was read for."""
    rows = answers.events_page(priced_by_catalogs(spark, directory), SPAN, "time_desc", 100)["events"]
    return rows.selectExpr(
        "event_id", "matched_kind", "matched_rule_id", "reason", "currency", "cost_atoms", "request_input.input_tokens AS request_input_tokens"
    )


@register(
    "answer_header_catalog",
    with_tables(
        f"""SELECT CAST(sum(total_tokens) AS VARCHAR) AS total_tokens, CAST(sum(CASE WHEN reason IS NULL THEN total_tokens END) AS VARCHAR) AS priced_total_tokens,
        {costs_sql('true')} AS costs, {REASONS_SQL} AS reasons FROM priced""",
        "facts",
        extra="evident AS " + EVIDENCE_SQL + ", " + rates.catalog_priced_sql(IN_F).replace("FROM facts f", "FROM evident f"),
    ),
)
def answer_header_catalog(spark, directory):
    row = answers.header(answers.Answer(priced_by_catalogs(spark, directory), SPAN))
    return row.selectExpr("total_tokens", "priced_total_tokens", COSTS, REASONS)


@register(
    "catalog_published_rules",
    with_tables("SELECT rule_id, count(*) AS events FROM (SELECT best_rule AS rule_id FROM rated WHERE same=1) GROUP BY 1", "facts",
                extra=rates.priced_sql(table=[*rates.BESIDE_CATALOGS, *rates.published_rows()])),
)
def catalog_published_rules(spark, directory):
    """Events by the rule that holds at their time, after each catalog was published twice."""
    documents = rates.catalogs(spark)
    table = catalog.published_rules(rates.rules(spark, rates.BESIDE_CATALOGS), documents, (1, 2))
    table = catalog.published_rules(table, documents, (1, 2))
    chosen = pricing.select_rules(UsageTables(spark, directory).facts, table, rates.aliases(spark), rates.REVISION)
    return chosen.where("rule IS NOT NULL").groupBy(F.col("rule.rule_id").alias("rule_id")).agg(F.expr("count(1) AS events"))


@register(
    "answer_context",
    with_tables(
        """SELECT context_tokens, observed_at_ms, quality FROM contexts WHERE session_key='s20' ORDER BY observed_at_ms DESC, context_id LIMIT 1""",
        "contexts",
    ),
)
def answer_context(spark, directory):
    return answers.context_of(model_of(spark, directory), "m20").select("context_tokens", "observed_at_ms", "quality")


NOW = DAY0 + 14 * 86_400_000 + 45_000_000


@register(
    "answer_small_scope",
    with_tables(
        f"""SELECT CAST(sum(total_tokens) AS VARCHAR) AS total_tokens, count(*) AS usage_event_count, {costs_sql('true')} AS costs FROM priced""",
        "facts",
        extra=rates.priced_sql(f"f.occurred_at_ms>={DAY0 + 14 * 86_400_000 + 18_000_000} AND f.occurred_at_ms<{NOW + 1}"),
    ),
)
def answer_small_scope(spark, directory):
    """Today in New York, up to a fixed now."""
    row = answers.small_scope(model_of(spark, directory), "America/New_York", "today", NOW)["header"]
    return row.selectExpr("total_tokens", "usage_event_count", COSTS)
