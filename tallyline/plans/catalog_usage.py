"""Registered checks: vectors, scalar functions, totals, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.functions import text as X, vectors as V
from tallyline.operators import filters, groups, measures
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.plans.oracle import with_tables, totals_columns
from tallyline.plans.registry import register
from tallyline.sources.tables import UsageTables

# Two weeks of January 2024 that start and end inside an hour.
START, END = 1_704_413_400_000, 1_705_624_500_000
SPAN = UsageFilter(START, END)
IN_SPAN = f"occurred_at_ms>={START} AND occurred_at_ms<{END}"


def span_facts(spark: SparkSession, directory: str) -> DataFrame:
    return UsageTables(spark, directory).usage(START, END)


@register("totals_all", with_tables(f"SELECT {totals_columns()} FROM facts", "facts"))
def totals_all(spark, directory):
    return measures.totals(UsageTables(spark, directory).facts)


@register("totals_range", with_tables(f"SELECT {totals_columns()} FROM facts WHERE {IN_SPAN}", "facts"))
def totals_range(spark, directory):
    return measures.totals(filters.apply_filter(span_facts(spark, directory), SPAN))


@register(
    "totals_empty_range",
    with_tables(f"SELECT {totals_columns()} FROM facts WHERE occurred_at_ms<1000", "facts"),
)
def totals_empty_range(spark, directory):
    return measures.totals(filters.apply_filter(UsageTables(spark, directory).facts, UsageFilter(0, 1000)))


MODEL_IDS = ("model:" + "0" * 64,)


@register(
    "groups_models",
    with_tables(
        f"""SELECT model_key AS dimension_key, min(model_label) AS label, {totals_columns()}
        FROM facts WHERE {IN_SPAN} GROUP BY model_key""",
        "facts",
    ),
)
def groups_models(spark, directory):
    facts = filters.apply_filter(span_facts(spark, directory), SPAN)
    return groups.ordered(groups.by_models(facts), "total_desc", 200)
