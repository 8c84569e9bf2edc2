"""Pricing of usage events against a versioned rate table.

Rates are a small table (at most 4096 rules and 4096 aliases, checked before broadcasting).
They are folded into one row per (provider, model) that carries its rules as an array, so
an event meets exactly one rate row in a map-side join and picks its rule there. Facts are
never multiplied by rules and never shuffled to be priced.

Money totals use that cost is linear in tokens: tokens are summed per rule as exact longs
and multiplied by the rates once per (group, rule), not once per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import text as X, vectors as V
from tallyline.model import MAX_ALIASES, MAX_PRICE_RULES
from tallyline.operators.measures import DEC, exact_sum
from tallyline.session import require_at_most

# Reasons for leaving an event unpriced.
UNKNOWN_MODEL = "unknown_model"
MISSING_RULE = "missing_rule"
AMBIGUOUS_RULE = "ambiguous_rule"
INSUFFICIENT_USAGE = "insufficient_usage"
INCOMPLETE_CONDITIONS = "incomplete_pricing_conditions"
OVERFLOW = "overflow"

RULE_FIELDS = (
    "rule_id",
    "introduced_revision",
    "source_id",
    "currency",
    "effective_from_ms",
    "effective_to_ms",
    "priority",
    "input_rate_atoms",
    "cached_rate_atoms",
    "cache_write_rate_atoms",
    "output_rate_atoms",
    "origin",
)


def visible_at(versions: DataFrame, revision: int) -> DataFrame:
    """Rows of a revisioned table that are in force at a revision."""
    return versions.where(
        (F.col("introduced_revision") <= revision)
        & (F.col("retired_revision").isNull() | (F.col("retired_revision") > revision))
    )


def rule_lists(rules: DataFrame, revision: int) -> DataFrame:
    live = require_at_most(visible_at(rules, revision), MAX_PRICE_RULES, "the rate table")
    rank = F.when(F.col("origin") == "offline", 1).otherwise(F.when(F.col("source_id").isNotNull(), 3).otherwise(2))
    return (
        live.withColumn("rank", rank * 100_000 + F.col("priority"))
        .groupBy(F.col("provider").alias("rate_provider"), F.col("model_exact").alias("rate_model"))
        .agg(F.collect_list(F.struct(*RULE_FIELDS, "rank")).alias("rules"))
    )


def alias_targets(aliases: DataFrame, revision: int) -> DataFrame:
    live = require_at_most(visible_at(aliases, revision), MAX_ALIASES, "the alias table")
    return live.groupBy(F.col("provider").alias("alias_provider"), F.col("alias").alias("alias_model")).agg(
        F.sort_array(F.collect_set("canonical_model")).alias("targets")
    )


def with_canonical_model(events: DataFrame, aliases: DataFrame, revision: int) -> DataFrame:
    """Send a model through its one-hop alias; two targets leave the name ambiguous."""
    targets = F.broadcast(alias_targets(aliases, revision))
    joined = events.join(
        targets,
        (F.col("provider") == F.col("alias_provider")) & (F.col("model") == F.col("alias_model")),
        "left",
    )
    several = F.coalesce(F.size("targets") > 1, F.lit(False))
    return joined.withColumns(
        {
            "alias_ambiguous": several,
            "canonical_model": F.when(~several, F.coalesce(F.get("targets", F.lit(0)), F.col("model"))),
        }
    ).drop("alias_provider", "alias_model", "targets")


def with_best_rule(events: DataFrame, rules: DataFrame, revision: int, specified_ms: int | None = None) -> DataFrame:
    """Add price_at_ms, rule (struct or NULL) and rule_ambiguous (several at the top rank)."""
    at = F.lit(specified_ms).cast("long") if specified_ms is not None else F.col("occurred_at_ms")
    lists = F.broadcast(rule_lists(rules, revision))
    joined = events.withColumn("price_at_ms", at).join(
        lists,
        (F.col("provider") == F.col("rate_provider")) & (F.col("canonical_model") == F.col("rate_model")),
        "left",
    )
    usable = (
        "r.effective_from_ms <= price_at_ms AND (r.effective_to_ms IS NULL OR price_at_ms < r.effective_to_ms)"
        " AND (r.source_id IS NULL OR array_contains(source_ids, r.source_id))"
    )
    return (
        joined.withColumn("live", F.expr(f"filter(rules, r -> {usable})"))
        .withColumn("top_rank", F.expr("array_max(transform(live, r -> r.rank))"))
        .withColumn("top", F.expr("filter(live, r -> r.rank = top_rank)"))
        .withColumns(
            {
                "rule_ambiguous": F.expr("alias_ambiguous OR coalesce(size(top) > 1, false)"),
                "rule": F.expr("CASE WHEN size(top) = 1 THEN top[0] END"),
            }
        )
        .drop("rate_provider", "rate_model", "rules", "live", "top", "top_rank", "alias_ambiguous")
    )


PARTS = ("charged_input", "charged_cached", "charged_write", "charged_output")
RATES = ("input_rate_atoms", "cached_rate_atoms", "cache_write_rate_atoms", "output_rate_atoms")

# Token quantities charged at each rate, over plain vector columns; meaningful where no gap is.
CHARGED = {
    "charged_input": "try_subtract(try_subtract(input_total, coalesce(cached_input, 0)), coalesce(cache_write_input, 0))",
    "charged_cached": "coalesce(cached_input, 0L)",
    "charged_write": "coalesce(cache_write_input, 0L)",
    "charged_output": "output_total",
}


def _part_blocks(quantity: str, rate: str, unrated_is_harmless: bool) -> str:
    """A part blocks pricing when it is charged without a rate, or unknown and able to matter."""
    harmless = f"remaining = 0 OR coalesce(rule.{rate} = rule.input_rate_atoms, false)"
    if unrated_is_harmless:
        harmless += f" OR rule.{rate} IS NULL"
    return (
        f"(coalesce({quantity} <> 0, false) AND rule.{rate} IS NULL)"
        f" OR ({quantity} IS NULL AND NOT coalesce({harmless}, false))"
    )


def usage_gap() -> str:
    """Why a vector cannot be priced with its rule, or NULL; reads remaining and vector_error."""
    lacking = " OR ".join(
        [
            "vector_error IS NOT NULL",
            "input_total IS NULL",
            "output_total IS NULL",
            "coalesce(remaining < 0, true)",
            _part_blocks("cached_input", "cached_rate_atoms", False),
            _part_blocks("cache_write_input", "cache_write_rate_atoms", True),
        ]
    )
    return (
        f"CASE WHEN vector_error = '{V.OVERFLOW}' THEN '{OVERFLOW}'"
        f" WHEN {lacking} THEN '{INSUFFICIENT_USAGE}' END"
    )


def outcome_reason() -> str:
    """Reason of an unpriced event in order of precedence; NULL means priced."""
    return (
        f"CASE WHEN provider IS NULL OR model IS NULL THEN '{UNKNOWN_MODEL}'"
        f" WHEN rule_ambiguous THEN '{AMBIGUOUS_RULE}'"
        f" WHEN conditions_missing THEN '{INCOMPLETE_CONDITIONS}'"
        f" WHEN rule IS NULL THEN '{MISSING_RULE}' ELSE {usage_gap()} END"
    )


def select_rules(
    events: DataFrame, rules: DataFrame, aliases: DataFrame, revision: int, specified_ms: int | None = None
) -> DataFrame:
    named = with_canonical_model(events, aliases, revision)
    chosen = with_best_rule(named, rules, revision, specified_ms)
    return chosen.withColumn("conditions_missing", F.lit(False))


def with_outcome(selected: DataFrame) -> DataFrame:
    """Add reason (NULL = priced) and the charged quantities; keeps ``rule`` for explanation."""
    judged = selected.withColumns(
        {"vector_error": F.expr(V.total_error("")), "remaining": F.expr(CHARGED["charged_input"])}
    ).withColumn("reason", F.expr(outcome_reason()))
    charged = {n: F.expr(f"CASE WHEN reason IS NULL THEN {text} END") for n, text in CHARGED.items()}
    return judged.withColumns(charged).drop("vector_error", "remaining")


def price_events(
    events: DataFrame, rules: DataFrame, aliases: DataFrame, revision: int, specified_ms: int | None = None
) -> DataFrame:
    """Events with rule, reason and charged quantities; the cost column is ``with_cost``."""
    return with_outcome(select_rules(events, rules, aliases, revision, specified_ms))


def _charges(digits: int, rate_prefix: str) -> str:
    """Exact cost of the charged quantities; a part without a rate counts only when it is zero."""
    terms = [
        f"CAST(CAST({part} AS DECIMAL({digits},0)) * coalesce({rate_prefix}{rate}, 0) AS {DEC})"
        for part, rate in zip(PARTS, RATES)
    ]
    return f"CAST({' + '.join(terms)} AS {DEC})"


def with_cost(priced: DataFrame) -> DataFrame:
    """Cost of each event, for answers that list events."""
    return priced.withColumns(
        {
            "cost_atoms": F.expr(f"CASE WHEN reason IS NULL THEN {_charges(20, 'rule.')} END"),
            "rule_id": F.expr("CASE WHEN reason IS NULL THEN rule.rule_id END"),
            "currency": F.expr("CASE WHEN reason IS NULL THEN rule.currency END"),
        }
    )


def _per_rule(priced: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (group, rule or reason): event count, tokens and cost."""
    from_rule = [f"CASE WHEN reason IS NULL THEN rule.{c} END AS {c}" for c in ("rule_id", "currency", *RATES)]
    rated = priced.selectExpr(*keys, "reason", "total_tokens", *PARTS, *from_rule)
    grouped = exact_sum(
        rated,
        [*keys, "reason", "rule_id", "currency"],
        {"tokens": "total_tokens", **{p: p for p in PARTS}},
        ["count(1) AS events", *[f"max({r}) AS {r}" for r in RATES]],
    )
    # A group's token sum stays within 22 digits far beyond any table size.
    cost = f"CASE WHEN reason IS NULL THEN {_charges(22, '')} END AS cost_atoms"
    return grouped.selectExpr(*keys, "reason", "rule_id", "currency", "events", "tokens", cost)


def currency_totals(priced: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per group and currency: cost and priced tokens."""
    return (
        _per_rule(priced, keys)
        .where(F.col("reason").isNull())
        .groupBy(*keys, "currency")
        .agg(F.sum("cost_atoms").alias("cost_atoms"), F.sum("tokens").alias("priced_total_tokens"))
        .withColumn("estimated_cost", X.money_from_atoms(F.col("cost_atoms")))
    )


def reason_totals(priced: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per group and reason: unpriced tokens and events."""
    return (
        _per_rule(priced, keys)
        .where(F.col("reason").isNotNull())
        .groupBy(*keys, F.col("reason").alias("code"))
        .agg(F.sum("tokens").alias("total_tokens"), F.sum("events").alias("event_count"))
    )


def pricing_summary(priced: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per group: currencies, reasons, priced and unpriced tokens, from one pass over the events."""
    rows = _per_rule(priced, keys).groupBy(*keys, "currency", "reason").agg(
        F.sum("tokens").alias("tokens"), F.sum("events").alias("events"), F.sum("cost_atoms").alias("cost_atoms")
    )
    zero = F.lit(0).cast(DEC)
    money = F.struct(
        F.col("currency"),
        X.money_from_atoms(F.col("cost_atoms")).alias("estimated_cost"),
        F.col("tokens").cast("string").alias("priced_total_tokens"),
    )
    gap = F.struct(
        F.col("reason").alias("code"),
        F.col("tokens").cast("string").alias("total_tokens"),
        F.col("events").alias("event_count"),
    )
    is_priced = F.col("reason").isNull()
    # Lists hold at most one entry per currency or reason.
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(is_priced, money))).alias("currencies"),
        F.sort_array(F.collect_list(F.when(~is_priced, gap))).alias("reasons"),
        F.coalesce(F.sum(F.when(is_priced, F.col("tokens"))), zero).alias("priced_total_tokens"),
        F.coalesce(F.sum(F.when(~is_priced, F.col("tokens"))), zero).alias("unpriced_total_tokens"),
    )


def conservation_breaks(totals: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose priced and unpriced tokens do not add up to their total; must be empty."""
    left = totals.select(*keys, F.col("total_tokens").alias("total"))
    right = summary.select(*keys, (F.col("priced_total_tokens") + F.col("unpriced_total_tokens")).alias("total"))
    signed = left.withColumn("sign", F.lit(1)).unionByName(right.withColumn("sign", F.lit(-1)))
    return (
        signed.groupBy(*keys)
        .agg(F.sum(F.col("total").cast(DEC) * F.col("sign")).alias("difference"))
        .where(F.col("difference") != 0)
    )


def require_conserved(breaks: DataFrame) -> None:
    if not breaks.isEmpty():
        raise ValueError("priced and unpriced tokens do not add up to the total")
