"""Stored valuations: priced events per revision and basis, and when they may be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.operators import pricing as P

CACHE_VERSION = 6
INPUTS = (
    "accounting_version", "provider", "model", "sources", "occurred_at_ms", "input_total", "cached_input",
    "cache_write_input", "output_total", "reasoning_output", "reported_total", "request_input",
)


def with_fingerprint(events: DataFrame) -> DataFrame:
    """Hash of everything that can change an event's price at a fixed revision and basis."""
    request = "request_input" if "request_input" in events.columns else "CAST(NULL AS STRING)"
    fields = {n: n for n in INPUTS} | {"sources": "array_sort(array_distinct(source_ids))", "request_input": request}
    packed = ", ".join(f"'{n}', {e}" for n, e in fields.items())
    text = f"to_json(named_struct('version', {CACHE_VERSION}, {packed}), map('ignoreNullFields', 'false'))"
    return events.withColumn("fingerprint", F.expr(f"sha2({text}, 256)"))


def basis_key(revision: int, specified_ms: int | None) -> str:
    return f"{revision}@{'event_time' if specified_ms is None else specified_ms}"


def build_valuations(
    events: DataFrame, rules: DataFrame, aliases: DataFrame, revision: int, specified_ms: int | None = None
) -> DataFrame:
    """One stored estimate per event for a (revision, basis); write it partitioned by basis."""
    priced = P.with_cost(P.price_events(with_fingerprint(events), rules, aliases, revision, specified_ms))
    return priced.select(
        F.lit(basis_key(revision, specified_ms)).alias("basis"), "ledger_id", "event_id", "fingerprint",
        F.coalesce("reason", F.lit("priced")).alias("status"), "rule_id", "currency", "cost_atoms",
    )


REASONS = (P.UNKNOWN_MODEL, P.MISSING_RULE, P.AMBIGUOUS_RULE, P.INSUFFICIENT_USAGE, P.INCOMPLETE_CONDITIONS, P.OVERFLOW)
WELL_FORMED = f"""CASE WHEN status = 'priced' THEN rule_id IS NOT NULL AND length(rule_id) BETWEEN 1 AND 256
AND currency RLIKE '^[A-Z]{{3}}$' AND cost_atoms >= 0
ELSE status IN ({', '.join(repr(r) for r in REASONS)}) AND rule_id IS NULL AND currency IS NULL AND cost_atoms IS NULL END"""


def reusable(stored: DataFrame, revision: int, specified_ms: int | None = None) -> DataFrame:
    """Estimates that can be trusted: well formed, and not contradicted by another of the same input."""
    mine = stored.where(F.col("basis") == basis_key(revision, specified_ms))
    outcome = "struct(status, rule_id, currency, cost_atoms)"
    merged = mine.groupBy("event_id", "fingerprint").agg(
        F.expr(f"bool_and(coalesce({WELL_FORMED}, false)) AS sound"),
        F.expr(f"min({outcome}) AS low"),
        F.expr(f"max({outcome}) AS high"),
    )
    return merged.where("sound AND low <=> high").select("event_id", "fingerprint", "low.*")


def price_with_reuse(
    events: DataFrame, stored: DataFrame, rules: DataFrame, aliases: DataFrame, revision: int, specified_ms: int | None = None
) -> DataFrame:
    """Outcome per event: the stored estimate of the same input where there is one, else live pricing.

    Only events without a usable estimate are priced.
    """
    marked = with_fingerprint(events)
    cached = reusable(stored, revision, specified_ms)
    shown = ("event_id", "total_tokens", "status", "rule_id", "currency", "cost_atoms", "reused")
    hit = marked.join(cached, ["event_id", "fingerprint"]).withColumn("reused", F.lit(True)).select(*shown)
    missed = marked.join(cached.select("event_id", "fingerprint"), ["event_id", "fingerprint"], "left_anti")
    live = P.with_cost(P.price_events(missed, rules, aliases, revision, specified_ms)).select(
        "event_id", "total_tokens", F.coalesce("reason", F.lit("priced")).alias("status"), "rule_id", "currency", "cost_atoms",
        F.lit(False).alias("reused"),
    )
    return hit.unionByName(live)


def revalue_plan(
    events: DataFrame, ledgers: DataFrame, ready: DataFrame, scope: str = "all", ids: tuple[str, ...] = ()
) -> DataFrame:
    """Active ledgers of a scope (all, sources, sessions) with event counts and whether done.

    ``ready`` holds the ledger_id of every ledger with a complete valuation of the basis.
    """
    if scope == "sessions":
        ledgers = ledgers.where(F.col("session_key").isin(*ids))
    if scope == "sources":
        wanted = F.array(*[F.lit(i) for i in ids])
        touched = events.where(F.arrays_overlap("source_ids", wanted)).select("ledger_id").distinct()
        ledgers = ledgers.join(touched, "ledger_id", "left_semi")
    counts = events.groupBy("ledger_id").agg(F.expr("count(1) AS event_count"))
    done = ready.select("ledger_id").distinct().withColumn("completed", F.lit(True))
    return (
        ledgers.select("ledger_id").join(counts, "ledger_id", "left").join(done, "ledger_id", "left")
        .selectExpr("ledger_id", "coalesce(event_count, 0L) AS event_count", "coalesce(completed, false) AS completed")
    )


def plan_progress(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.expr("count(1) AS total_ledgers"),
        F.expr("count_if(completed) AS completed_ledgers"),
        F.expr("coalesce(sum(event_count), 0L) AS total_events"),
        F.expr("coalesce(sum(CASE WHEN completed THEN event_count END), 0L) AS processed_events"),
    )


def broken_selections(priced: DataFrame, stored_quotes: DataFrame) -> DataFrame:
    """Chosen catalog quotes that differ from their stored form; must be empty."""
    rates = ("input_rate_atoms", "cached_rate_atoms", "cache_write_rate_atoms", "output_rate_atoms")
    chosen = priced.where("selection = 'request'").selectExpr(
        "rule.rule_id AS rule_id", "provider", "canonical_model AS model_exact", "rule.currency AS currency",
        *[f"rule.{r} AS {r}" for r in rates],
    ).distinct()
    kept = stored_quotes.select("rule_id", "provider", "model_exact", "currency", *rates)
    return chosen.exceptAll(kept.intersect(chosen))
