"""Edits of the versioned rate and alias tables: every edit is a new revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.model import MAX_ALIASES, MAX_PRICE_RULES
from tallyline.operators.pricing import visible_at


class RateConflict(ValueError):
    """The edit overlaps a rule or alias that is in force."""


def _retire(table: DataFrame, id_column: str, identity: str, revision: int, allowed: str) -> DataFrame:
    target = (F.col(id_column) == identity) & F.col("retired_revision").isNull() & F.expr(allowed)
    if table.where(target).isEmpty():
        raise ValueError(f"{identity} cannot be retired")
    return table.withColumn(
        "retired_revision", F.when(target, F.lit(revision).cast("long")).otherwise(F.col("retired_revision"))
    )


def overlapping_rules(table: DataFrame, draft: DataFrame, revision: int) -> DataFrame:
    """Custom rules in force that share provider, model, source and priority with a draft in time."""
    mine = visible_at(table, revision).where("origin = 'custom'").alias("a")
    d = draft.alias("d")  # one row
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("provider", "model_exact", "source_id", "priority")]
    meets = F.expr(
        "(d.effective_to_ms IS NULL OR a.effective_from_ms < d.effective_to_ms)"
        " AND (a.effective_to_ms IS NULL OR a.effective_to_ms > d.effective_from_ms)"
    )
    return mine.join(F.broadcast(d), same[0] & same[1] & same[2] & same[3] & meets, "left_semi")


def edit_rule(table: DataFrame, revision: int, draft: DataFrame | None = None, retire: str | None = None) -> DataFrame:
    """Create (draft), replace (both) or retire a custom rule; ``revision`` is the new revision."""
    edited = table if retire is None else _retire(table, "rule_id", retire, revision, "origin = 'custom'")
    if draft is None:
        return edited
    if not overlapping_rules(edited, draft, revision).isEmpty():
        raise RateConflict("a rule of the same provider, model, source and priority covers part of that time")
    if visible_at(edited, revision).limit(MAX_PRICE_RULES).count() >= MAX_PRICE_RULES:
        raise ValueError("the rate table is full")
    fresh = draft.withColumns(
        {"introduced_revision": F.lit(revision).cast("long"), "retired_revision": F.lit(None).cast("long"), "origin": F.lit("custom")}
    )
    return edited.unionByName(fresh.select(*edited.columns))


def conflicting_aliases(table: DataFrame, draft: DataFrame, revision: int) -> DataFrame:
    """Aliases in force that a draft would double or chain with."""
    a, d = visible_at(table, revision).alias("a"), draft.alias("d")
    clash = F.expr(
        "a.provider = d.provider AND (a.alias = d.alias OR a.alias = d.canonical_model OR a.canonical_model = d.alias)"
    )
    return a.join(F.broadcast(d), clash, "left_semi")


def edit_alias(table: DataFrame, revision: int, draft: DataFrame | None = None, retire: str | None = None) -> DataFrame:
    edited = table if retire is None else _retire(table, "alias_id", retire, revision, "startswith(alias_id, 'alias-custom-')")
    if draft is None:
        return edited
    if not conflicting_aliases(edited, draft, revision).isEmpty():
        raise RateConflict("an alias must not repeat or chain")
    if visible_at(edited, revision).limit(MAX_ALIASES).count() >= MAX_ALIASES:
        raise ValueError("the alias table is full")
    fresh = draft.withColumns({"introduced_revision": F.lit(revision).cast("long"), "retired_revision": F.lit(None).cast("long")})
    return edited.unionByName(fresh.select(*edited.columns))
