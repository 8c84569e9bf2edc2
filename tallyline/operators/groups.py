"""Groups by model or project, with labels, order, limit and group counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions import text as X
from tallyline.model import UNKNOWN_MODEL_LABEL, UNKNOWN_PROJECT_LABEL
from tallyline.operators.measures import totals_by


def by_models(facts: DataFrame) -> DataFrame:
    """Totals per (provider, model). An unknown model is one group whatever its provider.

    Grouping runs on the plain names; the opaque key is hashed once per group.
    """
    known = facts.withColumn("provider", F.when(F.col("model").isNotNull(), F.col("provider")))
    grouped = totals_by(known, ["provider", "model"])
    provider, model = F.col("provider"), F.col("model")
    return grouped.select(
        X.model_key(provider, model).alias("dimension_key"),
        X.model_label(provider, model, UNKNOWN_MODEL_LABEL).alias("label"),
        *[c for c in grouped.columns if c not in ("provider", "model")],
    )


def project_label(unknown: str = UNKNOWN_PROJECT_LABEL) -> Column:
    return F.coalesce(F.col("user_alias"), F.col("display_name"), F.lit(unknown))


def by_projects(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Totals per project; labels are joined after grouping, when a row is a whole project."""
    grouped = totals_by(facts, ["project_id"])
    labelled = grouped.join(projects, "project_id", "left")
    return labelled.select(
        F.col("project_id").alias("dimension_key"),
        project_label().alias("label"),
        *[c for c in grouped.columns if c != "project_id"],
    )


def ordered(groups: DataFrame, sort: str, limit: int) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("a group list holds 1 to 200 rows")
    order = {
        "total_desc": [F.desc("total_tokens"), F.asc_nulls_first("dimension_key")],
        "name_asc": [F.asc("label"), F.asc_nulls_first("dimension_key")],
    }[sort]
    return groups.orderBy(*order).limit(limit)


def group_count(facts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """How many groups there are, the unknown one included, and whether a list cuts them off."""
    distinct = facts.select(*keys).distinct()
    return distinct.agg(F.count(F.lit(1)).alias("total_group_count")).select(
        "total_group_count", (F.col("total_group_count") > limit).alias("truncated")
    )


def shares(groups: DataFrame) -> DataFrame:
    """Share of the overall total and cache hit ratio (only where both parts are complete)."""
    overall = groups.agg(F.sum("total_tokens").alias("overall_total"))
    both_complete = F.col("cached_input_complete") & F.col("input_total_complete")
    # ``overall`` is a one-row aggregate, so its broadcast size is fixed.
    return groups.join(F.broadcast(overall), F.lit(True)).select(
        "dimension_key",
        X.percentage(F.col("total_tokens"), F.col("overall_total")).alias("share_percent"),
        F.when(both_complete, X.percentage(F.col("cached_input"), F.col("input_total"))).alias(
            "cache_hit_percent"
        ),
    )
