"""Registered checks: scalar functions, filters, series, sessions, facets, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import text as X, vectors as V
from tallyline.operators import calendar, coverage, facets, filters, groups, measures, pages, series, sessions
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.plans.catalog_usage import END, IN_SPAN, SPAN, START
from tallyline.plans.oracle import MEASURES, cte, totals_columns, with_tables
from tallyline.plans.registry import register
from tallyline.sources.tables import UsageTables

# Usage vectors that break the rules on purpose, one kind per remainder of k.
RAW_CASES = {
    "input_total": ("CASE WHEN k = 1 THEN -1 WHEN k = 2 THEN 9223372036854775807 WHEN k IN (3, 4) THEN NULL ELSE t - t {div} 4 END"),
    "cached_input": ("CASE WHEN k = 5 THEN t - t {div} 4 + 1 WHEN k = 2 THEN 0 WHEN k = 4 THEN t + 1 WHEN k = 6 THEN NULL ELSE t {div} 2 END"),
    "cache_write_input": ("CASE WHEN k = 7 THEN t WHEN k IN (2, 4) THEN 0 WHEN k = 8 THEN NULL ELSE t {div} 8 END"),
    "output_total": ("CASE WHEN k = 2 THEN 1 WHEN k IN (9, 4) THEN NULL ELSE t {div} 4 END"),
    "reasoning_output": ("CASE WHEN k = 10 THEN t {div} 4 + 1 WHEN k IN (2, 11, 4) THEN NULL ELSE t {div} 8 END"),
    "reported_total": ("CASE WHEN k = 2 OR k = 12 THEN NULL WHEN k = 13 THEN t + 1 ELSE t END"),
}
RAW_SPARK = {n: text.format(div="div") for n, text in RAW_CASES.items()}
RAW_SQL = ", ".join(f"CAST({text.format(div='//')} AS BIGINT) AS {n}" for n, text in RAW_CASES.items())
cte("raw_vectors", "facts0")(
    f"SELECT event_id, {RAW_SQL} FROM (SELECT event_id, k, total_tokens AS t FROM facts0)"
)
cte("judged", "raw_vectors")(
    """SELECT *, CASE WHEN least(coalesce(input_total,0),coalesce(cached_input,0),coalesce(cache_write_input,0),
      coalesce(output_total,0),coalesce(reasoning_output,0),coalesce(reported_total,0))<0 THEN 'INVALID_USAGE'
    WHEN coalesce(cached_input>input_total OR cache_write_input>input_total
      OR CAST(cached_input AS HUGEINT)+cache_write_input>input_total OR reasoning_output>output_total,false) THEN 'INVALID_USAGE'
    WHEN CAST(input_total AS HUGEINT)+output_total>9223372036854775807 THEN 'NUMERIC_OVERFLOW'
    WHEN CAST(input_total AS HUGEINT)+output_total<>reported_total THEN 'INVALID_USAGE' END AS error_v1,
    coalesce(CAST(input_total AS HUGEINT),CAST(coalesce(cached_input,0) AS HUGEINT)+coalesce(cache_write_input,0))
      +coalesce(output_total,reasoning_output,0)>reported_total AS below FROM raw_vectors"""
)


def raw_vectors(spark, directory):
    base = UsageTables(spark, directory).facts.selectExpr("event_id", "k", "total_tokens AS t")
    return base.selectExpr("event_id", *[f"CAST({e} AS BIGINT) AS {n}" for n, e in RAW_SPARK.items()])


TOTAL_SQL = "coalesce(CASE WHEN input_total IS NOT NULL AND output_total IS NOT NULL THEN CAST(input_total AS HUGEINT)+output_total END, reported_total)"


@register(
    "vector_totals",
    with_tables(
        f"""SELECT event_id, error_v1, coalesce(error_v1, CASE WHEN below THEN 'INVALID_USAGE' END) AS error,
        CAST(CASE WHEN error_v1 IS NULL THEN {TOTAL_SQL} END AS BIGINT) AS total_v1,
        CAST(CASE WHEN error_v1 IS NULL AND NOT coalesce(below,false) THEN {TOTAL_SQL} END AS BIGINT) AS total
        FROM judged""",
        "judged",
    ),
)
def vector_totals(spark, directory):
    return raw_vectors(spark, directory).selectExpr(
        "event_id",
        f"{V.total_error_v1('')} AS error_v1",
        f"{V.total_error('')} AS error",
        f"{V.validated_total_v1('')} AS total_v1",
        f"{V.validated_total('')} AS total",
    )


@register(
    "published_totals",
    with_tables(
        f"""SELECT v, coalesce(CASE WHEN v='accounting-v2' THEN coalesce(error_v1, CASE WHEN below THEN 'INVALID_USAGE' END)
        WHEN v='accounting-v1' THEN error_v1 ELSE 'UNSUPPORTED_FORMAT' END, 'ok') AS outcome, count(*) AS vectors
        FROM judged, (VALUES ('accounting-v1'),('accounting-v2'),('accounting-v9')) t(v) GROUP BY ALL""",
        "judged",
    ),
)
def published_totals(spark, directory):
    versions = F.explode(F.array(*[F.lit(f"accounting-v{n}") for n in (1, 2, 9)])).alias("v")
    rows = raw_vectors(spark, directory).select("*", versions)
    outcome = f"coalesce({V.published_error('', 'v')}, 'ok') AS outcome"
    return rows.selectExpr("v", outcome).groupBy("v", "outcome").agg(F.expr("count(1) AS vectors"))


@register(
    "vector_differences",
    with_tables(
        """SELECT session_key, count(*) AS pairs, count_if(ok) AS usable, CAST(sum(CASE WHEN ok THEN total_tokens-pt END) AS VARCHAR) AS delta
        FROM (SELECT *, coalesce((pi IS NULL)=(input_total IS NULL) AND (pc IS NULL)=(cached_input IS NULL)
          AND (pw IS NULL)=(cache_write_input IS NULL) AND (pr IS NULL)=(reasoning_output IS NULL)
          AND total_tokens>=pt AND coalesce(input_total>=pi,true) AND coalesce(cached_input>=pc,true)
          AND coalesce(cache_write_input>=pw,true) AND coalesce(output_total>=po,true) AND coalesce(reasoning_output>=pr,true)
          AND coalesce(cached_input-pc<=input_total-pi,true) AND coalesce(cache_write_input-pw<=input_total-pi,true)
          AND coalesce((cached_input-pc)+(cache_write_input-pw)<=input_total-pi,true)
          AND coalesce(reasoning_output-pr<=output_total-po,true), false) AS ok
          FROM (SELECT *, lag(total_tokens) OVER w AS pt, lag(input_total) OVER w AS pi, lag(cached_input) OVER w AS pc,
            lag(cache_write_input) OVER w AS pw, lag(output_total) OVER w AS po, lag(reasoning_output) OVER w AS pr
            FROM facts WINDOW w AS (PARTITION BY session_key ORDER BY occurred_at_ms, event_id)) WHERE pt IS NOT NULL)
        GROUP BY session_key""",
        "facts",
    ),
)
def vector_differences(spark, directory):
    from tallyline.operators.scan import chunked_scan

    rows = UsageTables(spark, directory).facts.selectExpr(
        "session_key", "occurred_at_ms", "event_id", f"{V.pack_columns()} AS vector"
    )
    paired = chunked_scan(
        rows,
        ["session_key"],
        "occurred_at_ms div 86400000",
        ["occurred_at_ms", "event_id"],
        previous={"before": "vector"},
    ).where("before IS NOT NULL")
    differing = paired.withColumn("difference", F.expr(V.raw_difference("vector", "before")))
    judged = differing.withColumn("usable", F.expr(f"{V.difference_error('vector', 'before', 'difference')} IS NULL"))
    return judged.groupBy("session_key").agg(
        F.expr("count(1) AS pairs"),
        F.expr("count_if(usable) AS usable"),
        F.expr("sum(CAST(CASE WHEN usable THEN difference.reported_total END AS DECIMAL(38,0))) AS delta"),
    )


@register(
    "vector_json_totals",
    with_tables("SELECT pending_id, vector_total AS total FROM pending", "pending"),
)
def vector_json_totals(spark, directory):
    return UsageTables(spark, directory).pending.selectExpr("pending_id", f"{V.usage_vector_total('vector_json')} AS total")


@register(
    "noncached_and_comparable",
    with_tables(
        """SELECT session_key, CAST(sum(noncached_input) AS VARCHAR) AS noncached, count_if(input_total IS NOT NULL
        AND output_total IS NOT NULL) AS comparable FROM facts GROUP BY session_key""",
        "facts",
    ),
)
def noncached_and_comparable(spark, directory):
    rows = UsageTables(spark, directory).facts.withColumn("v", F.expr(V.pack_columns()))
    return rows.groupBy("session_key").agg(
        F.expr(f"sum(CAST({V.noncached_input('')} AS DECIMAL(38,0))) AS noncached"),
        F.expr(f"count_if({V.comparable('v', 'v')}) AS comparable"),
    )


@register(
    "rate_texts",
    """SELECT p_partkey, p_retailprice AS price, CAST(round(p_retailprice*100) AS BIGINT)*10000000 AS atoms,
    regexp_replace(regexp_replace(CAST(CAST(round(p_retailprice*100) AS BIGINT)//100 AS VARCHAR)||'.'
      ||lpad(CAST(CAST(round(p_retailprice*100) AS BIGINT)%100 AS VARCHAR),2,'0'),'0+$',''),'\\.$','') AS shown FROM part""",
)
def rate_texts(spark, directory):
    parts = UsageTables(spark, directory).raw("part")
    text = F.format_string("%.2f", F.col("p_retailprice"))
    atoms = X.rate_atoms(text)
    return parts.select("p_partkey", F.col("p_retailprice").alias("price"), atoms.cast("long").alias("atoms"), X.rate_per_million(atoms).alias("shown"))


COMPACT_SQL = """CASE WHEN {n}>=1000000000 THEN CAST(({n}*10+500000000)//1000000000//10 AS VARCHAR)||'.'||CAST(({n}*10+500000000)//1000000000%10 AS VARCHAR)||'B'
WHEN {n}>=1000000 THEN CAST(({n}*10+500000)//1000000//10 AS VARCHAR)||'.'||CAST(({n}*10+500000)//1000000%10 AS VARCHAR)||'M'
WHEN {n}>=1000 THEN CAST(({n}*10+500)//1000//10 AS VARCHAR)||'.'||CAST(({n}*10+500)//1000%10 AS VARCHAR)||'K' ELSE CAST({n} AS VARCHAR) END"""


@register(
    "display_texts",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {COMPACT_SQL.format(n='n')} AS compact, {COMPACT_SQL.format(n='(n*1000)')} AS compact_large,
    CAST((n*10000000000+5000000000000)//10000000000000//100 AS VARCHAR)||'.'||lpad(CAST((n*10000000000+5000000000000)//10000000000000%100 AS VARCHAR),2,'0') AS money,
    CASE WHEN d>0 AND d<=n THEN CAST((d*10000+n//2)//n AS DOUBLE)/100.0 END AS percent
    FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS n, CAST(round(l_quantity*l_discount*100000) AS BIGINT) AS d FROM lineitem) WHERE true""",
)
def display_texts(spark, directory):
    lines = UsageTables(spark, directory).raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS n", "CAST(round(l_quantity * l_discount * 100000) AS BIGINT) AS d",
    )
    percent = F.when(F.col("d") > 0, X.percentage(F.col("d"), F.col("n")))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.compact_tokens(F.col("n")).alias("compact"),
        X.compact_tokens(F.col("n") * 1000).alias("compact_large"),
        X.money_rounded(F.col("n").cast("decimal(38,0)") * 10_000_000_000).alias("money"),
        percent.alias("percent"),
    )


@register(
    "search_sessions",
    """SELECT c_custkey, contains(lower(c_name), lower('R#00')) AS hit, contains(lower(c_name), '%') AS wildcard FROM customer""",
)
def search_sessions(spark, directory):
    customers = UsageTables(spark, directory).raw("customer")
    return customers.select("c_custkey", X.search_contains(F.col("c_name"), "R#00").alias("hit"), X.search_contains(F.col("c_name"), "%").alias("wildcard"))


@register(
    "hour_floors",
    with_tables(
        """SELECT event_id, CAST(floor((occurred_at_ms-1704500000000)/3600000.0) AS BIGINT)*3600000 AS hour,
        regexp_matches(CAST(occurred_at_ms-1704500000000 AS VARCHAR),'^(0|[1-9][0-9]*)$') AS canonical,
        strftime(make_timestamp((occurred_at_ms-18000000)*1000),'%Y-%m-%d') AS local_day FROM facts""",
        "facts",
    ),
)
def hour_floors(spark, directory):
    shifted = F.col("occurred_at_ms") - 1_704_500_000_000
    return UsageTables(spark, directory).facts.select(
        "event_id",
        X.utc_hour(shifted).alias("hour"),
        X.is_canonical_integer(shifted.cast("string")).alias("canonical"),
        X.local_date(F.col("occurred_at_ms"), "America/New_York").alias("local_day"),
    )


# --- filters -----------------------------------------------------------------------------


def _key(provider, model):
    import hashlib

    text = f'["{provider}","{model}"]' if provider else f'[null,"{model}"]'
    return "model:" + hashlib.sha256(text.encode()).hexdigest()


FILTERS = {
    "models": (
        {"models": Selection.of(_key("alpha", "view"), _key(None, "click"))},
        "(provider='alpha' AND model='view' OR provider IS NULL AND model='click')",
    ),
    "models_and_unknown": (
        {"models": Selection.of(_key("beta", "click"), include_unknown=True)},
        "(provider='beta' AND model='click' OR model IS NULL)",
    ),
    "projects": ({"projects": Selection.of("p1", "p4")}, "project_id IN ('p1','p4')"),
    "projects_unknown_only": ({"projects": Selection.of(include_unknown=True)}, "project_id IS NULL"),
    "nothing": ({"projects": Selection.of()}, "false"),
    "sources": ({"sources": Selection.of("src1")}, "list_contains(source_ids,'src1')"),
    "sessions_by_alias": (
        {"sessions": Selection.of("s7", "m20", "m30", include_unknown=True)},
        "session_key IN ('s7', 's20', 's30')",
    ),
}


def _filtered(name, selections, condition):
    spec = UsageFilter(START, END, **selections)

    @register(
        f"filter_{name}",
        with_tables(f"SELECT {totals_columns()} FROM facts WHERE {IN_SPAN} AND {condition}", "facts"),
    )
    def query(spark, directory):
        tables = UsageTables(spark, directory)
        aliases = tables.aliases if name == "sessions_by_alias" else None
        return measures.totals(filters.apply_filter(tables.usage(START, END), spec, aliases))


for _name, (_selections, _condition) in FILTERS.items():
    _filtered(_name, _selections, _condition)


@register(
    "filter_sources_by_provenance",
    with_tables(
        f"""SELECT {totals_columns()} FROM facts WHERE {IN_SPAN} AND EXISTS (SELECT 1 FROM provenance p
        WHERE p.event_id=facts.event_id AND p.source_id IN ('src0','src1'))""",
        "provenance",
    ),
)
def filter_sources_by_provenance(spark, directory):
    tables = UsageTables(spark, directory)
    evidence = tables.facts.select("event_id", F.explode("source_ids").alias("source_id"))
    spec = UsageFilter(START, END, sources=Selection.of("src0", "src1"))
    return measures.totals(filters.apply_filter(tables.usage(START, END), spec, provenance=evidence))


@register(
    "filter_active_ledgers",
    with_tables(
        f"SELECT {totals_columns()} FROM facts WHERE ledger_id IN (SELECT active_ledger_id FROM sessions)",
        "facts",
        "sessions",
    ),
)
def filter_active_ledgers(spark, directory):
    tables = UsageTables(spark, directory)
    return measures.totals(filters.active_only(tables.facts, tables.sessions))


@register(
    "filter_pending",
    with_tables(
        f"""SELECT kind, count(*) AS rows_kept FROM pending WHERE (observed_at_ms IS NULL OR observed_at_ms>={START}
        AND observed_at_ms<{END}) AND (project_id='p2' OR project_id IS NULL) GROUP BY kind""",
        "pending",
    ),
)
def filter_pending(spark, directory):
    spec = UsageFilter(START, END, projects=Selection.of("p2", include_unknown=True))
    kept = filters.apply_pending_filter(UsageTables(spark, directory).pending, spec)
    return kept.groupBy("kind").agg(F.expr("count(1) AS rows_kept"))


# --- joins, groups, windows ---------------------------------------------------------------


@register(
    "groups_projects",
    with_tables(
        f"""SELECT f.project_id AS dimension_key, min(coalesce(p.user_alias,p.display_name,'未知项目')) AS label,
        {totals_columns('f.')} FROM facts f LEFT JOIN projects p ON p.project_id=f.project_id WHERE {IN_SPAN} GROUP BY 1""",
        "facts",
        "projects",
    ),
)
def groups_projects(spark, directory):
    tables = UsageTables(spark, directory)
    kept = filters.apply_filter(tables.usage(START, END), SPAN)
    return groups.ordered(groups.by_projects(kept, tables.projects), "total_desc", 200)


@register(
    "groups_top_by_name",
    with_tables(
        """SELECT model_key AS dimension_key, min(model_label) AS label, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens
        FROM facts GROUP BY 1 ORDER BY label, dimension_key NULLS FIRST LIMIT 5""",
        "facts",
    ),
)
def groups_top_by_name(spark, directory):
    named = groups.by_models(UsageTables(spark, directory).facts)
    return groups.ordered(named, "name_asc", 5).select("dimension_key", "label", "total_tokens")


@register(
    "group_count",
    with_tables("SELECT count(*) AS total_group_count, count(*)>5 AS truncated FROM (SELECT DISTINCT model_key FROM facts)", "facts"),
)
def group_count(spark, directory):
    return groups.group_count(UsageTables(spark, directory).facts, ["model_key"], 5)


@register(
    "group_shares",
    with_tables(
        """SELECT model_key AS dimension_key,
        CAST((CAST(sum(total_tokens) AS BIGINT)*10000+(SELECT sum(total_tokens) FROM facts)//2)//(SELECT CAST(sum(total_tokens) AS BIGINT) FROM facts) AS DOUBLE)/100.0 AS share_percent,
        CAST(NULL AS DOUBLE) AS cache_hit_percent FROM facts GROUP BY 1""",
        "facts",
    ),
)
def group_shares(spark, directory):
    return groups.shares(groups.by_models(UsageTables(spark, directory).facts))


@register(
    "event_sources",
    with_tables(
        """SELECT event_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources,
        count(*) AS observations FROM provenance GROUP BY event_id""",
        "provenance",
    ),
)
def event_sources(spark, directory):
    tables = UsageTables(spark, directory)
    chain = (
        tables.provenance.join(tables.generations.select("file_generation_id", "file_id"), "file_generation_id")
        .join(tables.files.select("file_id", "source_id"), "file_id")
    )
    return chain.groupBy("event_id").agg(
        F.expr("concat_ws(',', sort_array(collect_set(source_id))) AS sources"), F.expr("count(1) AS observations")
    )


@register(
    "session_parents",
    with_tables(
        """SELECT s.session_key, p.session_key AS parent_key, coalesce(p.provider_session_id,p.session_key) AS parent_display_name
        FROM sessions s LEFT JOIN aliases a ON a.alias_session_key=s.parent_key LEFT JOIN sessions p
        ON p.session_key=coalesce(a.canonical_session_key,s.parent_key) AND p.active_ledger_id IS NOT NULL""",
        "sessions",
        "aliases",
    ),
)
def session_parents(spark, directory):
    tables = UsageTables(spark, directory)
    return sessions.parents(tables.sessions, tables.aliases)


CHILD_SQL = """SELECT coalesce(a.canonical_session_key,s.parent_key) AS session_key, s.session_key AS child_key
FROM sessions s LEFT JOIN aliases a ON a.alias_session_key=s.parent_key WHERE s.active_ledger_id IS NOT NULL
AND s.parent_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM aliases x WHERE x.alias_session_key=s.session_key)"""


@register("session_children", with_tables(CHILD_SQL, "sessions", "aliases"))
def session_children(spark, directory):
    tables = UsageTables(spark, directory)
    return sessions.children(tables.sessions, tables.aliases)


@register(
    "session_child_counts",
    with_tables(f"SELECT session_key, count(*) AS child_count FROM ({CHILD_SQL}) GROUP BY 1", "sessions", "aliases"),
)
def session_child_counts(spark, directory):
    tables = UsageTables(spark, directory)
    return sessions.child_counts(tables.sessions, tables.aliases)


@register(
    "sessions_totals",
    with_tables(
        f"SELECT session_key, max(occurred_at_ms) AS latest_at_ms, {totals_columns()} FROM facts GROUP BY session_key", "facts"
    ),
)
def sessions_totals(spark, directory):
    return sessions.session_totals(UsageTables(spark, directory).facts)


LATEST_SQL = """SELECT session_key, model AS latest_model, project_id AS latest_project_id FROM
(SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY occurred_at_ms DESC, event_id) AS rn FROM facts) WHERE rn=1"""


@register("sessions_latest_activity", with_tables(LATEST_SQL, "facts"))
def sessions_latest_activity(spark, directory):
    return sessions.latest_activity(UsageTables(spark, directory).facts)


@register(
    "sessions_latest_context",
    with_tables(
        """SELECT session_key, observed_at_ms, context_tokens, model_context_window, quality,
        CAST(context_tokens AS DOUBLE)/CAST(model_context_window AS DOUBLE)*100.0 AS percentage FROM (SELECT *, row_number()
        OVER (PARTITION BY session_key ORDER BY observed_at_ms DESC, context_id) AS rn FROM contexts) WHERE rn=1""",
        "contexts",
    ),
)
def sessions_latest_context(spark, directory):
    latest = sessions.latest_context(UsageTables(spark, directory).contexts)
    return latest.withColumn("model_context_window", F.col("model_context_window").cast("int"))


@register(
    "turns_totals",
    with_tables(
        f"""SELECT session_key, turn_id, min(occurred_at_ms) AS first_at_ms, max(occurred_at_ms) AS last_at_ms, {totals_columns()}
        FROM facts WHERE turn_id IS NOT NULL GROUP BY session_key, turn_id""",
        "facts",
    ),
)
def turns_totals(spark, directory):
    return sessions.turn_totals(UsageTables(spark, directory).facts)


@register(
    "turns_unidentified",
    with_tables("SELECT count(*)-count(turn_id) AS unidentified_usage_event_count FROM facts", "facts"),
)
def turns_unidentified(spark, directory):
    return sessions.unidentified_events(UsageTables(spark, directory).facts)


@register(
    "session_classifications",
    with_tables(
        "SELECT session_key, kind, reason_code, count(DISTINCT observation_id) AS observation_count FROM pending GROUP BY ALL",
        "pending",
    ),
)
def session_classifications(spark, directory):
    return sessions.classifications(UsageTables(spark, directory).pending)


@register(
    "ledger_versions",
    with_tables("SELECT DISTINCT l.parser_version, l.accounting_version FROM facts f JOIN ledgers l ON l.ledger_id=f.ledger_id", "facts", "ledgers"),
)
def ledger_versions(spark, directory):
    tables = UsageTables(spark, directory)
    used = tables.facts.select("ledger_id").distinct()
    return tables.ledgers.join(used, "ledger_id", "left_semi").select("parser_version", "accounting_version").distinct()


@register(
    "alias_repointing",
    with_tables(
        """SELECT alias_session_key, CASE WHEN canonical_session_key='s20' THEN 's7' ELSE canonical_session_key END AS canonical_session_key
        FROM aliases UNION ALL SELECT 's20','s7'""",
        "aliases",
    ),
)
def alias_repointing(spark, directory):
    fresh = spark.createDataFrame([("s20", "s7")], "alias_session_key string, canonical_session_key string")
    return sessions.repoint_aliases(UsageTables(spark, directory).aliases, fresh)


# --- facets and pages ---------------------------------------------------------------------


@register(
    "facet_models",
    with_tables("SELECT model_key AS dimension_key, min(model_label) AS label, count(*) AS amount FROM facts GROUP BY 1", "facts"),
)
def facet_models(spark, directory):
    return facets.model_options(UsageTables(spark, directory).facts)


@register(
    "facet_projects",
    with_tables(
        """SELECT f.project_id AS dimension_key, min(coalesce(user_alias,display_name,'未知项目')) AS label, count(*) AS amount
        FROM facts f LEFT JOIN projects p ON p.project_id=f.project_id GROUP BY 1""",
        "facts",
        "projects",
    ),
)
def facet_projects(spark, directory):
    tables = UsageTables(spark, directory)
    spec = UsageFilter(0, 2_000_000_000_000, projects=Selection.of("p1")).without("projects")
    return facets.project_options(filters.apply_filter(tables.facts, spec), tables.projects)


@register(
    "facet_sessions_search",
    with_tables(
        """SELECT f.session_key AS dimension_key, coalesce(provider_session_id,f.session_key) AS label, count(*) AS amount
        FROM facts f JOIN sessions s ON s.session_key=f.session_key GROUP BY ALL
        HAVING contains(lower(coalesce(provider_session_id,f.session_key)), 'v-1') ORDER BY 1 LIMIT 21""",
        "facts",
        "sessions",
    ),
)
def facet_sessions_search(spark, directory):
    tables = UsageTables(spark, directory)
    options = facets.searched(facets.session_options(tables.facts, tables.sessions), "V-1")
    return pages.key_page(options, "dimension_key", 20)


@register(
    "facet_sources",
    with_tables(
        """SELECT s.source_id AS dimension_key, root_path||CASE WHEN enabled THEN '' ELSE '（暂停）' END AS label,
        (SELECT count(DISTINCT event_id) FROM provenance p WHERE p.source_id=s.source_id) AS amount FROM sources s""",
        "sources",
    ),
)
def facet_sources(spark, directory):
    tables = UsageTables(spark, directory)
    return facets.source_options(tables.facts, tables.sources)


def _page(name, descending, sql_order):
    @register(
        f"events_page_{name}",
        with_tables(
            f"""SELECT event_id, occurred_at_ms, total_tokens FROM facts WHERE {IN_SPAN} AND ({sql_order}) ORDER BY {descending} DESC,
            event_id LIMIT 51""",
            "facts",
        ),
    )
    def query(spark, directory):
        position = {"occurred_at_ms": (1_705_500_000_000, "000000005000"), "total_tokens": (2000, "000000005000")}[descending]
        rows = UsageTables(spark, directory).usage(START, END).select("event_id", "occurred_at_ms", "total_tokens")
        return pages.page(rows, descending, "event_id", 50, position)


_page("by_time", "occurred_at_ms", "occurred_at_ms<1705500000000 OR occurred_at_ms=1705500000000 AND event_id>'000000005000'")
_page("by_total", "total_tokens", "total_tokens<2000 OR total_tokens=2000 AND event_id>'000000005000'")


@register(
    "sessions_page_probe",
    with_tables(
        """SELECT session_key, latest_at_ms, true AS has_more FROM (SELECT session_key, max(occurred_at_ms) AS latest_at_ms
        FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
        "facts",
    ),
)
def sessions_page_probe(spark, directory):
    facts = UsageTables(spark, directory).facts
    latest = facts.groupBy("session_key").agg(F.expr("max(occurred_at_ms) AS latest_at_ms"))
    found = pages.page(latest, "latest_at_ms", "session_key", 10)
    return pages.split_probe(found, 10, F.desc("latest_at_ms"), F.asc("session_key"))


@register(
    "session_picker",
    with_tables(
        """SELECT s.session_key, coalesce(s.provider_session_id,s.session_key) AS display_name FROM sessions s WHERE
        active_ledger_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.alias_session_key=s.session_key)
        ORDER BY s.session_key LIMIT 101""",
        "sessions",
        "aliases",
    ),
)
def session_picker(spark, directory):
    tables = UsageTables(spark, directory)
    own = sessions.published(tables.sessions).join(
        tables.aliases.select(F.col("alias_session_key").alias("session_key")), "session_key", "left_anti"
    )
    named = own.select("session_key", F.coalesce("provider_session_id", "session_key").alias("display_name"))
    return pages.key_page(named, "session_key", 100)


# --- series -------------------------------------------------------------------------------

DAY0, DAYS = 1_704_067_200_000, 31


def _series_sql(offset_ms, width, start, end, label):
    """Buckets of fixed width in a zone with a fixed offset, clipped to the range."""
    first = (start + offset_ms) // width * width - offset_ms
    count = -(-(end - first) // width)
    return with_tables(
        f"""SELECT CAST(i AS INTEGER) AS bucket_index, greatest({start},{first}+i*{width}) AS start_ms,
        least({end},{first}+(i+1)*{width}) AS end_ms,
        strftime(make_timestamp(({first}+i*{width}+({offset_ms}))*1000),'{label}') AS display_label,
        '{calendar.offset_text(offset_ms)}' AS utc_offset, {totals_columns('f.')}
        FROM range({count}) t(i) LEFT JOIN facts f ON f.occurred_at_ms>=greatest({start},{first}+i*{width})
        AND f.occurred_at_ms<least({end},{first}+(i+1)*{width}) GROUP BY i""",
        "facts",
    )


@register("series_utc_days", _series_sql(0, 86_400_000, DAY0 - 86_400_000, DAY0 + 33 * 86_400_000, "%Y-%m-%d"))
def series_utc_days(spark, directory):
    return series.series(UsageTables(spark, directory).facts, DAY0 - 86_400_000, DAY0 + 33 * 86_400_000, "UTC", "day")


@register("series_new_york_days", _series_sql(-18_000_000, 86_400_000, START, END, "%Y-%m-%d"))
def series_new_york_days(spark, directory):
    return series.series(UsageTables(spark, directory).usage(START, END), START, END, "America/New_York", "day")


@register("series_kathmandu_hours", _series_sql(20_700_000, 3_600_000, START, END, "%Y-%m-%d %H:%M"))
def series_kathmandu_hours(spark, directory):
    return series.series(UsageTables(spark, directory).usage(START, END), START, END, "Asia/Kathmandu", "hour")


@register(
    "series_months",
    with_tables(
        f"""SELECT CAST(i AS INTEGER) AS bucket_index, epoch_ms(d) AS start_ms, epoch_ms(d+INTERVAL 1 MONTH) AS end_ms,
        strftime(d,'%Y-%m') AS display_label, '+00:00' AS utc_offset, {totals_columns('f.')}
        FROM (SELECT i, TIMESTAMP '2023-12-01'+INTERVAL (i) MONTH AS d FROM range(4) t(i)) LEFT JOIN facts f
        ON f.occurred_at_ms>=epoch_ms(d) AND f.occurred_at_ms<epoch_ms(d+INTERVAL 1 MONTH) GROUP BY i, d""",
        "facts",
    ),
)
def series_months(spark, directory):
    start, end = 1_701_388_800_000, 1_711_929_600_000
    return series.series(UsageTables(spark, directory).facts, start, end, "UTC", "month")


HEAT_SQL = """SELECT d AS day_index, CAST(total AS VARCHAR) AS total_tokens,
CASE WHEN total=0 THEN 0 ELSE CAST((total*3+(SELECT max(total) FROM daily)-1)//(SELECT max(total) FROM daily) AS INTEGER) END AS heat_level,
CAST(total*10000//(SELECT max(total) FROM daily) AS DOUBLE)/100.0 AS bar_height FROM daily"""
DAILY = f"""daily AS (SELECT CAST(i AS INTEGER) AS d, coalesce(sum(total_tokens),0) AS total FROM range({DAYS}) t(i) LEFT JOIN facts f
ON f.occurred_at_ms>={DAY0}+i*86400000 AND f.occurred_at_ms<{DAY0}+(i+1)*86400000 GROUP BY i)"""


@register("heatmap_levels", with_tables(HEAT_SQL, "facts", extra=DAILY))
def heatmap_levels(spark, directory):
    facts = UsageTables(spark, directory).usage(DAY0, DAY0 + DAYS * 86_400_000)
    days = series.series(facts, DAY0, DAY0 + DAYS * 86_400_000, "UTC", "day")
    leveled = series.bar_heights(series.heat_levels(days))
    return leveled.select(F.col("bucket_index").alias("day_index"), "total_tokens", "heat_level", "bar_height")


GAPS_SQL = f"""SELECT CAST(i AS INTEGER) AS bucket_index, {DAY0}+i*86400000 AS start_ms,
count_if(kind='pending') AS pending_observation_count, count_if(kind='unattributed') AS unattributed_observation_count,
CASE WHEN count_if(kind='unattributed')>0 AND count_if(kind='unattributed' AND vector_total IS NULL)=0
THEN CAST(sum(CASE WHEN kind='unattributed' THEN vector_total END) AS VARCHAR) END AS unattributed_total_tokens
FROM range({DAYS}) t(i) LEFT JOIN pending p ON p.kind IN ('pending','unattributed') AND (observed_at_ms IS NULL OR
observed_at_ms>={DAY0}+i*86400000 AND observed_at_ms<{DAY0}+(i+1)*86400000) GROUP BY i"""


@register("gap_series", with_tables(GAPS_SQL, "pending"))
def gap_series(spark, directory):
    bins = calendar.buckets(DAY0, DAY0 + DAYS * 86_400_000, "UTC", "day")
    return coverage.gap_series(UsageTables(spark, directory).pending, bins)
