"""Redaction of answers: names become stable labels, money and reasons go, tokens stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What a hidden thing is called.
SESSION, PROJECT, SOURCE, PARENT = "会话", "项目", "来源", "父会话"
HIDDEN = "（已隐藏）"


def label(kind: str, key: Column) -> Column:
    """``kind #`` and twelve hash digits of the key, or a hidden mark when there is no key."""
    known = F.concat(F.lit(f"{kind} #"), F.substring(F.sha2(key, 256), 1, 12))
    return F.when(key.isNotNull(), known).otherwise(F.lit(kind + HIDDEN))


def _relabel(df: DataFrame, column: str, kind: str, key: Column) -> DataFrame:
    """Replace a name that is shown; one that is not stays absent."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.when(F.col(column).isNotNull(), label(kind, key)))


def redact_pricing(df: DataFrame) -> DataFrame:
    """Drop costs, rules and reasons, and say so."""
    gone = ("estimated_cost", "cost_atoms", "rule_id", "currency", "reason", "matched_kind", "matched_rule_id", "matched_source_specific")
    cleared = {c: F.lit(None).cast(df.schema[c].dataType) for c in gone if c in df.columns}
    if "reasons" in df.columns:
        cleared["reasons"] = F.expr("filter(reasons, r -> false)")
    if "currencies" in df.columns:
        cleared["currencies"] = F.expr("transform(currencies, c -> named_struct('currency', c.currency, 'estimated_cost', CAST(NULL AS STRING), 'priced_total_tokens', c.priced_total_tokens))")
    return df.withColumns({**cleared, "redacted": F.lit(True)})


def redact_sessions(df: DataFrame) -> DataFrame:
    """Session rows and pages, recent sessions and children."""
    df = df.withColumn("display_name", label(SESSION, F.col("session_key")))
    df = _relabel(df, "latest_project_name", PROJECT, F.col("latest_project_id")) if "latest_project_id" in df.columns else df
    if "parent_key" in df.columns:
        df = _relabel(df, "parent_display_name", SESSION, F.col("parent_key"))
    return _relabel(df, "parent_provider_id", PARENT, F.lit(None).cast("string"))


def redact_events(df: DataFrame) -> DataFrame:
    df = _relabel(df, "session_display_name", SESSION, F.col("session_key"))
    df = _relabel(df, "project_display_name", PROJECT, F.col("project_id"))
    return redact_pricing(df)


def redact_options(df: DataFrame, dimension: str) -> DataFrame:
    """Facet or group labels; models stay visible, unknown keys keep their label."""
    kind = {"projects": PROJECT, "sessions": SESSION, "sources": SOURCE}.get(dimension)
    if kind is None:
        return df
    key = F.col("dimension_key")
    return df.withColumn("label", F.when(key.isNotNull(), label(kind, key)).otherwise(F.col("label")))


def redact_issues(df: DataFrame) -> DataFrame:
    """Paths of problems are hidden, their offsets are kept."""
    return df.withColumn("path", F.lit(None).cast("string"))
