"""Registered checks: pricing of events and summaries, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import catalog, groups, measures, pricing
from tallyline.plans import rates
from tallyline.plans.oracle import with_tables
from tallyline.plans.registry import register
from tallyline.sources.tables import UsageTables

MONEY_SQL = """regexp_replace(substring(lpad(CAST({0} AS VARCHAR),39,'0'),1,24),'^0+([0-9])','\\1')||'.'
||substring(lpad(CAST({0} AS VARCHAR),39,'0'),25,15)"""


def money_sql(expression: str) -> str:
    return MONEY_SQL.format(expression)


def priced(spark, directory, revision=rates.REVISION, specified_ms=None):
    facts = UsageTables(spark, directory).facts
    return pricing.price_events(facts, rates.rules(spark), rates.aliases(spark), revision, specified_ms)


EVENT_COLUMNS = "event_id, reason, rule_id, currency, CAST(cost_atoms AS VARCHAR) AS cost_atoms"


@register(
    "priced_events",
    with_tables(f"SELECT {EVENT_COLUMNS} FROM priced", "facts", extra=rates.priced_sql()),
)
def priced_events(spark, directory):
    return pricing.with_cost(priced(spark, directory)).select(
        "event_id", "reason", "rule_id", "currency", "cost_atoms"
    )


@register(
    "priced_events_old_revision",
    with_tables(f"SELECT {EVENT_COLUMNS} FROM priced", "facts", extra=rates.priced_sql(revision=1)),
)
def priced_events_old_revision(spark, directory):
    return pricing.with_cost(priced(spark, directory, revision=1)).select(
        "event_id", "reason", "rule_id", "currency", "cost_atoms"
    )


@register(
    "priced_events_specified_time",
    with_tables(
        f"SELECT {EVENT_COLUMNS} FROM priced", "facts", extra=rates.priced_sql(specified_ms=rates.MID - 1)
    ),
)
def priced_events_specified_time(spark, directory):
    return pricing.with_cost(priced(spark, directory, specified_ms=rates.MID - 1)).select(
        "event_id", "reason", "rule_id", "currency", "cost_atoms"
    )


@register(
    "pricing_by_currency",
    with_tables(
        f"""SELECT currency, CAST(sum(cost_atoms) AS VARCHAR) AS cost_atoms,
        CAST(sum(total_tokens) AS VARCHAR) AS priced_total_tokens, {money_sql('sum(cost_atoms)')} AS estimated_cost
        FROM priced WHERE reason IS NULL GROUP BY currency""",
        "facts",
        extra=rates.priced_sql(),
    ),
)
def pricing_by_currency(spark, directory):
    return pricing.currency_totals(priced(spark, directory))


@register(
    "pricing_by_reason",
    with_tables(
        """SELECT reason AS code, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens, count(*) AS event_count
        FROM priced WHERE reason IS NOT NULL GROUP BY reason""",
        "facts",
        extra=rates.priced_sql(),
    ),
)
def pricing_by_reason(spark, directory):
    return pricing.reason_totals(priced(spark, directory))


def _summary_sql(*keys: str) -> str:
    key = ", ".join(keys)
    same = " AND ".join(f"q.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""SELECT {key}, CAST(coalesce(sum(CASE WHEN reason IS NULL THEN total_tokens END),0) AS VARCHAR)
      AS priced_total_tokens,
    CAST(coalesce(sum(CASE WHEN reason IS NOT NULL THEN total_tokens END),0) AS VARCHAR) AS unpriced_total_tokens,
    coalesce((SELECT string_agg(c.currency||' '||c.cost, ';' ORDER BY c.currency) FROM
      (SELECT currency, {money_sql('sum(q.cost_atoms)')} AS cost FROM priced q
       WHERE q.reason IS NULL AND {same} GROUP BY currency) c), '') AS costs
    FROM priced p GROUP BY {key}"""


def _flat_summary(summary, *keys):
    costs = F.transform("currencies", lambda c: F.concat_ws(" ", c.currency, c.estimated_cost))
    return summary.select(*keys, "priced_total_tokens", "unpriced_total_tokens", F.concat_ws(";", costs).alias("costs"))


@register("pricing_by_project", with_tables(_summary_sql("project_id"), "facts", extra=rates.priced_sql()))
def pricing_by_project(spark, directory):
    return _flat_summary(pricing.pricing_summary(priced(spark, directory), ["project_id"]), "project_id")


@register("pricing_by_session", with_tables(_summary_sql("session_key"), "facts", extra=rates.priced_sql()))
def pricing_by_session(spark, directory):
    return _flat_summary(pricing.pricing_summary(priced(spark, directory), ["session_key"]), "session_key")


@register("pricing_by_turn", with_tables(_summary_sql("session_key", "turn_id"), "facts", extra=rates.priced_sql()))
def pricing_by_turn(spark, directory):
    return _flat_summary(pricing.pricing_summary(priced(spark, directory), ["session_key", "turn_id"]), "session_key", "turn_id")


@register(
    "pricing_conservation",
    with_tables(
        """SELECT model, CAST(0 AS BIGINT) AS broken_groups, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens
        FROM facts GROUP BY model""",
        "facts",
    ),
)
def pricing_conservation(spark, directory):
    facts = UsageTables(spark, directory).facts
    totals = measures.totals_by(facts, ["model"])
    breaks = pricing.conservation_breaks(totals, pricing.pricing_summary(priced(spark, directory), ["model"]), ["model"])
    counted = breaks.agg(F.count(F.lit(1)).alias("broken_groups"))
    return totals.select("model", "total_tokens").join(F.broadcast(counted), F.lit(True))


RULE_KIND_SQL = """CASE WHEN best_rule IS NULL OR alias_amb OR same>1 THEN NULL
WHEN origin='custom' THEN 'custom_rule' ELSE 'offline_rule' END"""


@register(
    "matched_rule_kinds",
    with_tables(
        f"""SELECT {RULE_KIND_SQL} AS matched_kind, CASE WHEN {RULE_KIND_SQL} IS NOT NULL THEN best_rule END AS matched_rule_id,
        CASE WHEN {RULE_KIND_SQL}='custom_rule' THEN rule_source IS NOT NULL END AS matched_source_specific,
        count(*) AS events FROM priced GROUP BY ALL""",
        "facts",
        extra=rates.priced_sql(),
    ),
)
def matched_rule_kinds(spark, directory):
    chosen = priced(spark, directory).withColumn("selection", F.lit("rule"))
    return (
        catalog.explanation(chosen)
        .groupBy("matched_kind", "matched_rule_id", "matched_source_specific")
        .agg(F.count(F.lit(1)).alias("events"))
    )
