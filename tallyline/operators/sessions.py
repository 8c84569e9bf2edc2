"""Sessions: per-session totals, relations, turns, classifications and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.operators.measures import KNOWN_TURN, measure_sums, merge_partials, partials_by, present_totals
from tallyline.operators.pages import latest_by


def published(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("active_ledger_id").isNotNull())


def through_alias(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a session key by its canonical key where it is a mirror key (one hop)."""
    keys = aliases.select(F.col("alias_session_key").alias(column), "canonical_session_key")
    return (
        rows.join(keys, column, "left")
        .withColumn(column, F.coalesce("canonical_session_key", column))
        .drop("canonical_session_key")
    )


def alias_chains(aliases: DataFrame) -> DataFrame:
    """Aliases that point at another alias; publication requires this to be empty."""
    heads = aliases.select(F.col("alias_session_key").alias("canonical_session_key"))
    return aliases.join(heads, "canonical_session_key", "left_semi")


def repoint_aliases(aliases: DataFrame, published_now: DataFrame) -> DataFrame:
    """Alias table after a publication: old aliases follow their target when it became one."""
    moved = published_now.select(
        F.col("alias_session_key").alias("canonical_session_key"),
        F.col("canonical_session_key").alias("next_key"),
    )
    kept = (
        aliases.join(published_now.select("alias_session_key"), "alias_session_key", "left_anti")
        .join(moved, "canonical_session_key", "left")
        .select("alias_session_key", F.coalesce("next_key", "canonical_session_key").alias("canonical_session_key"))
    )
    return kept.unionByName(published_now.select("alias_session_key", "canonical_session_key"))


def parents(sessions: DataFrame, aliases: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Each (wanted) session with its parent, resolved through aliases, when the parent is published."""
    asked = sessions if wanted is None else wanted
    linked = through_alias(asked.select("session_key", "parent_key"), "parent_key", aliases)
    heads = published(sessions).select(
        F.col("session_key").alias("parent_key"),
        F.coalesce("provider_session_id", "session_key").alias("parent_display_name"),
        F.lit(True).alias("parent_found"),
    )
    return linked.join(heads, "parent_key", "left").select(
        "session_key", F.when(F.col("parent_found"), F.col("parent_key")).alias("parent_key"), "parent_display_name"
    )


def children(sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(session_key, child_key) for published children that are not mirrors themselves."""
    own = published(sessions).join(
        aliases.select(F.col("alias_session_key").alias("session_key")), "session_key", "left_anti"
    )
    linked = through_alias(own.where(F.col("parent_key").isNotNull()), "parent_key", aliases)
    return linked.select(F.col("parent_key").alias("session_key"), F.col("session_key").alias("child_key"))


def child_counts(sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    return children(sessions, aliases).groupBy("session_key").agg(F.expr("count(1) AS child_count"))


def _only_around(sessions: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """Sessions whose parent key leads to one of a few sessions, directly or as a mirror key."""
    mirrors = aliases.join(
        F.broadcast(keys.select(F.col("session_key").alias("canonical_session_key"))), "canonical_session_key", "left_semi"
    )
    wanted = keys.select(F.col("session_key").alias("parent_key")).unionByName(
        mirrors.select(F.col("alias_session_key").alias("parent_key"))
    )
    return sessions.join(wanted, "parent_key", "left_semi")


def session_totals(facts: DataFrame) -> DataFrame:
    """Totals per session with its newest event time."""
    keys = ["session_key"]
    merged = merge_partials(partials_by(facts, keys), keys)
    newest = facts.groupBy("session_key").agg(F.expr("max(occurred_at_ms) AS latest_at_ms"))
    return present_totals(merged, keys).join(newest, "session_key")


def latest_activity(facts: DataFrame) -> DataFrame:
    """Model and project of each session's newest event (smallest id on equal times)."""
    return latest_by(facts, ["session_key"], "occurred_at_ms", "event_id", ["model", "project_id"]).select(
        "session_key", F.col("model").alias("latest_model"), F.col("project_id").alias("latest_project_id")
    )


def describe_sessions(rows: DataFrame, facts: DataFrame, sessions: DataFrame, aliases: DataFrame, projects: DataFrame) -> DataFrame:
    """Complete a page of session rows: names, relations, latest model and project.

    Pages are small, so everything joined to them is cut down to the page's sessions first.
    """
    keys = F.broadcast(rows.select("session_key"))  # a page: at most 201 rows
    latest = latest_activity(facts.join(keys, "session_key", "left_semi"))
    mine = sessions.join(keys, "session_key", "left_semi")
    named = mine.select(
        "session_key", F.coalesce("provider_session_id", "session_key").alias("display_name"), "parent_provider_id"
    )
    names = projects.select(
        F.col("project_id").alias("latest_project_id"),
        F.coalesce("user_alias", "display_name").alias("latest_project_name"),
    )
    return (
        rows.join(named, "session_key")
        .join(latest, "session_key")
        .join(names, "latest_project_id", "left")
        .join(parents(sessions, aliases, mine), "session_key", "left")
        .join(child_counts(_only_around(sessions, aliases, keys), aliases), "session_key", "left")
        .withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("long"))
    )


def turn_totals(facts: DataFrame) -> DataFrame:
    """Totals per session and named turn with its first and last time."""
    named = facts.where(F.expr(KNOWN_TURN))
    keys = ["session_key", "turn_id"]
    # A group is one turn of one session, so nothing distinct is left to count beside the sums.
    times = ["min(occurred_at_ms) AS first_at_ms", "max(occurred_at_ms) AS last_at_ms"]
    sums = measure_sums(named.where("session_key IS NOT NULL"), keys, times)
    counted = sums.withColumns({"session_count": F.lit(1).cast("long"), "turn_count": F.lit(1).cast("long")})
    shown = present_totals(counted, keys, "first_at_ms", "last_at_ms")
    return shown.select(*[c for c in shown.columns if c not in ("first_at_ms", "last_at_ms")], "first_at_ms", "last_at_ms")


def unidentified_events(facts: DataFrame) -> DataFrame:
    return facts.agg(F.expr("count_if(turn_id IS NULL OR turn_id = '') AS unidentified_usage_event_count"))


def classifications(pending: DataFrame, keys: list[str] = ["session_key"]) -> DataFrame:
    """Observations per kind and reason; an observation is counted once however often listed."""
    distinct = pending.select(*keys, "kind", "reason_code", "observation_id").distinct()
    return distinct.groupBy(*keys, "kind", "reason_code").agg(F.expr("count(1) AS observation_count"))


def latest_context(contexts: DataFrame, keys: list[str] = ["session_key"]) -> DataFrame:
    """Newest context size per session and its share of the window, which may exceed 100."""
    newest = latest_by(
        contexts, keys, "observed_at_ms", "context_id", ["context_tokens", "model_context_window", "quality"]
    )
    return newest.withColumnRenamed("latest_observed_at_ms", "observed_at_ms").withColumn(
        "percentage", F.expr("CAST(context_tokens AS DOUBLE) / CAST(model_context_window AS DOUBLE) * 100.0D")
    )
