"""Session titles from index logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.operators.normalize import rfc3339_ms

SCHEMA = "id string, thread_name string, updated_at string"


def latest_titles(lines: DataFrame) -> DataFrame:
    """Newest title per session: later lines win ties; blank, broken or undated lines are skipped.

    ``lines``: line and line_no (its order in the index).
    """
    parsed = lines.select("line_no", F.from_json("line", SCHEMA).alias("t"))
    usable = parsed.selectExpr("line_no", "t.id AS session_key", "t.thread_name AS title", f"{rfc3339_ms('t.updated_at')} AS updated_at_ms").where(
        "session_key <> '' AND trim(title) <> '' AND updated_at_ms IS NOT NULL"
    )
    return usable.groupBy("session_key").agg(
        F.expr("max_by(title, struct(updated_at_ms, line_no)) AS title"), F.expr("max(updated_at_ms) AS updated_at_ms")
    )


def with_titles(rows: DataFrame, titles: DataFrame, key: str = "provider_session_id") -> DataFrame:
    """Show the title, else the provider's session id, else the session key."""
    named = titles.select(F.col("session_key").alias(key), "title")
    return rows.join(named, key, "left").withColumn("display_name", F.coalesce("title", key, "session_key")).drop("title")
