"""Registered checks of the stored tables: batches, late events, maintained rollups, guarded offsets.

Each check loads the events into a store of its own, in several batches, and reads them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyline.operators import calendar, rollup
from tallyline.plans.catalog_usage import END, IN_SPAN, SPAN, START
from tallyline.plans.filter_checks import _series_sql
from tallyline.plans.oracle import totals_columns, with_tables
from tallyline.plans.registry import register
from tallyline.session import scratch_dir
from tallyline.sources.commits import CommitConflict
from tallyline.sources.tables import UsageTables
from tallyline.sources.usage_store import UsageStore

LATE = "event_number % 10 = 3"


def store_of(spark, directory) -> UsageStore:
    """All events: most in one batch, a tenth late in a second one, which then comes again."""
    store = UsageStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    facts = UsageTables(spark, directory).facts
    store.append("load", 0, facts.where(f"NOT ({LATE})"))
    for _ in range(2):
        store.append("load", 1, facts.where(LATE))
    return store


def _stored_parts(store: UsageStore):
    at = store.log.revision()
    ledgers = store.sessions(at).select("ledger_id").distinct()
    return store.events(at), store.hours(at).drop("day"), store.turns(at).drop("day"), ledgers, store.ready_ledgers(at)


@register("stored_totals", with_tables(f"SELECT {totals_columns()} FROM facts WHERE {IN_SPAN}", "facts"))
def stored_totals(spark, directory):
    """Totals of a range from stored hours; only the cut hours at its ends are read as events."""
    return rollup.hybrid_totals(*_stored_parts(store_of(spark, directory)), SPAN)


@register("stored_series", _series_sql(20_700_000, 86_400_000, START, END, "%Y-%m-%d"))
def stored_series(spark, directory):
    bins = calendar.buckets(START, END, "Asia/Kathmandu", "day")
    return rollup.hybrid_series(*_stored_parts(store_of(spark, directory)), SPAN, bins)


@register(
    "stored_hours",
    with_tables(
        """SELECT ledger_id, occurred_at_ms//3600000*3600000 AS hour_start_ms, CASE WHEN model IS NOT NULL THEN provider END AS provider, model, project_id,
        array_to_string(source_ids, ',') AS sources, CAST(sum(total_tokens) AS VARCHAR) AS total_tokens, count(*) AS usage_event_count FROM facts GROUP BY ALL""",
        "facts",
    ),
)
def stored_hours(spark, directory):
    """Every stored hour after the late batch reached it."""
    return store_of(spark, directory).hours().selectExpr(
        "ledger_id", "hour_start_ms", "provider", "model", "project_id", "replace(sources, '\\n', ',') AS sources", "total_tokens", "usage_event_count"
    )


@register(
    "stored_offsets",
    with_tables(
        "SELECT 'g'||user_id AS file_generation_id, count(*) AS committed_offset, count(*) AS events, 2 AS revision, 2 AS refused FROM facts0 GROUP BY user_id", "facts0"
    ),
)
def stored_offsets(spark, directory):
    """Files committed in two guarded steps. A replay changes nothing, and two writers that know an
    older state are refused."""
    store = UsageStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    facts = UsageTables(spark, directory).facts.withColumn("file_generation_id", F.expr("concat('g', user_id)"))
    early = "event_number % 2 = 0"
    sizes = facts.groupBy("file_generation_id").agg(F.expr(f"count_if({early}) AS half"), F.expr("count(1) AS whole"))
    first = sizes.selectExpr("file_generation_id", "0L AS expected_offset", "half AS committed_offset")
    second = sizes.selectExpr("file_generation_id", "half AS expected_offset", "whole AS committed_offset")
    start = store.log.revision().number
    refused = 0
    attempts = [
        ("reader", 0, early, first, start), ("reader", 1, f"NOT ({early})", second, None), ("reader", 1, f"NOT ({early})", second, None),
        ("stale offsets", 0, early, first, None), ("stale revision", 0, early, second, start),
    ]
    for writer, batch, rows, offsets, expected in attempts:
        try:
            store.append(writer, batch, facts.where(rows), offsets=offsets, expected=expected)
        except CommitConflict:
            refused += 1
    held = store.events().selectExpr("concat('g', substring(session_key, 2)) AS file_generation_id").groupBy("file_generation_id").agg(F.count("*").alias("events"))
    at = store.log.revision()
    return store.log.offsets(at).join(held, "file_generation_id").withColumns({"revision": F.lit(at.number), "refused": F.lit(refused)})
