"""Choices of a filter dimension with how many events each has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import text as X
from tallyline.model import UNKNOWN_MODEL_LABEL
from tallyline.operators.groups import project_label


def _count(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.expr("count(1) AS amount"))


def model_options(facts: DataFrame) -> DataFrame:
    known = facts.withColumn("provider", F.expr("CASE WHEN model IS NOT NULL THEN provider END"))
    provider, model = F.col("provider"), F.col("model")
    return _count(known, "provider", "model").select(
        X.model_key(provider, model).alias("dimension_key"),
        X.model_label(provider, model, UNKNOWN_MODEL_LABEL).alias("label"),
        "amount",
    )


def project_options(facts: DataFrame, projects: DataFrame) -> DataFrame:
    return (
        _count(facts, "project_id")
        .join(projects, "project_id", "left")
        .select(F.col("project_id").alias("dimension_key"), project_label().alias("label"), "amount")
    )


def session_options(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    return (
        _count(facts, "session_key")
        .join(sessions.select("session_key", "provider_session_id"), "session_key")
        .select(
            F.col("session_key").alias("dimension_key"),
            F.coalesce("provider_session_id", "session_key").alias("label"),
            "amount",
        )
    )


def source_options(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Every registered source, the idle ones with zero; an event counts once per source."""
    used = facts.select(F.explode(F.array_distinct("source_ids")).alias("source_id"))
    counts = _count(used, "source_id")
    paused = F.when(~F.col("enabled"), F.lit("（暂停）")).otherwise(F.lit(""))
    return sources.join(counts, "source_id", "left").select(
        F.col("source_id").alias("dimension_key"),
        F.concat("root_path", paused).alias("label"),
        F.coalesce("amount", F.lit(0)).cast("long").alias("amount"),
    )


def searched(options: DataFrame, search: str) -> DataFrame:
    return options.where(X.search_contains(F.col("label"), search)) if search else options
