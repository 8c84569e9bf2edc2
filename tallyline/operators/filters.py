"""Usage filters: time range, models, projects, sessions and sources."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.model import MAX_EPOCH_MS, MAX_SELECTION_IDS


@dataclass(frozen=True)
class Selection:
    """All rows (``ids is None``), or the rows of some ids and, if asked, the unknown ones."""

    ids: tuple[str, ...] | None = None
    include_unknown: bool = False

    @classmethod
    def of(cls, *ids: str, include_unknown: bool = False) -> "Selection":
        return cls(tuple(ids), include_unknown)

    @property
    def is_all(self) -> bool:
        return self.ids is None

    def validate(self) -> None:
        if self.ids is None:
            return
        if len(self.ids) > MAX_SELECTION_IDS or len(set(self.ids)) != len(self.ids):
            raise ValueError("a selection takes up to 100 distinct ids")
        for name in self.ids:
            if not name or len(name) > 256 or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
                raise ValueError("malformed id in selection")

    def matches(self, column: Column) -> Column:
        """Empty ids without unknowns match nothing."""
        if self.ids is None:
            return F.lit(True)
        known = column.isin(*self.ids) if self.ids else F.lit(False)
        hit = F.coalesce(known, F.lit(False))
        return (hit | column.isNull()) if self.include_unknown else hit


@dataclass(frozen=True)
class UsageFilter:
    start_ms: int
    end_ms: int
    timezone: str = "UTC"
    models: Selection = field(default_factory=Selection)
    projects: Selection = field(default_factory=Selection)
    sessions: Selection = field(default_factory=Selection)
    sources: Selection = field(default_factory=Selection)

    def validate(self) -> "UsageFilter":
        if not -MAX_EPOCH_MS <= self.start_ms < self.end_ms <= MAX_EPOCH_MS:
            raise ValueError("the range must be a non-empty half-open interval")
        if not self.timezone or len(self.timezone) > 128:
            raise ValueError("a time zone name is needed")
        try:
            zoneinfo.ZoneInfo(self.timezone)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError) as error:
            raise ValueError(f"unknown time zone {self.timezone}") from error
        for part in (self.models, self.projects, self.sessions, self.sources):
            part.validate()
        return self

    def without(self, dimension: str) -> "UsageFilter":
        """The same filter with one dimension open: what a facet of that dimension counts over."""
        return replace(self, **{dimension: Selection()})


def validate_page(page_size: int, search: str = "") -> None:
    if not 1 <= page_size <= 200:
        raise ValueError("a page holds 1 to 200 rows")
    if len(search) > 256 or any(ord(c) < 32 for c in search):
        raise ValueError("search text is limited to 256 printable characters")


def in_range(time: Column, start_ms: int, end_ms: int) -> Column:
    return (time >= F.lit(start_ms)) & (time < F.lit(end_ms))


def canonical_ids(df: DataFrame, ids: tuple[str, ...], aliases: DataFrame | None) -> DataFrame:
    """The (at most 100) asked session keys, each sent through its alias."""
    asked = df.sparkSession.createDataFrame([(i,) for i in ids], "asked string")
    if aliases is None:
        return asked.select(F.col("asked").alias("canonical"))
    # Inner join against the bounded side first, so the alias table is never broadcast whole.
    hits = aliases.join(F.broadcast(asked), F.col("alias_session_key") == F.col("asked")).select(
        "asked", "canonical_session_key"
    )
    return asked.join(hits, "asked", "left").select(
        F.coalesce("canonical_session_key", "asked").alias("canonical")
    )


def keep_sessions(df: DataFrame, selection: Selection, aliases: DataFrame | None = None) -> DataFrame:
    """Sessions are asked for by key or by mirror key; unknowns do not exist in this dimension."""
    if selection.is_all:
        return df
    if not selection.ids:
        return df.where(F.lit(False))
    if aliases is None:
        return df.where(F.col("session_key").isin(*selection.ids))
    # At most 100 keys: broadcasting them is safe at any scale.
    keys = canonical_ids(df, selection.ids, aliases).distinct()
    return df.join(F.broadcast(keys), F.col("session_key") == F.col("canonical"), "left_semi")


def keep_sources(
    df: DataFrame, selection: Selection, provenance: DataFrame | None = None
) -> DataFrame:
    """Events with evidence in some source, each once however many mirrors it has.

    With the sources kept on the fact this is a map-side test. ``provenance`` (event_id,
    source_id) is for facts that do not carry them and costs one semi join.
    """
    if selection.is_all:
        return df
    if not selection.ids:
        return df.where(F.lit(False))
    if provenance is None:
        wanted = F.array(*[F.lit(s) for s in selection.ids])
        return df.where(F.arrays_overlap("source_ids", wanted))
    hits = provenance.where(F.col("source_id").isin(*selection.ids)).select("event_id")
    return df.join(hits, "event_id", "left_semi")


def apply_filter(
    facts: DataFrame,
    spec: UsageFilter,
    aliases: DataFrame | None = None,
    provenance: DataFrame | None = None,
    time: str = "occurred_at_ms",
) -> DataFrame:
    spec.validate()
    kept = facts.where(in_range(F.col(time), spec.start_ms, spec.end_ms))
    if not spec.models.is_all:
        kept = kept.where(spec.models.matches(F.col("model_key")))
    if not spec.projects.is_all:
        kept = kept.where(spec.projects.matches(F.col("project_id")))
    kept = keep_sessions(kept, spec.sessions, aliases)
    return keep_sources(kept, spec.sources, provenance)


def pending_matches(spec: UsageFilter, time: str = "observed_at_ms") -> Column:
    """Pending rows of a filter: one whose time is unknown may belong to any range."""
    spec.validate()
    at = F.col(time)
    matched = at.isNull() | in_range(at, spec.start_ms, spec.end_ms)
    for selection, column in ((spec.models, "model_key"), (spec.projects, "project_id")):
        if not selection.is_all:
            matched = matched & selection.matches(F.col(column))
    if not spec.sources.is_all:
        matched = matched & spec.sources.matches(F.col("source_id"))
    return matched


def apply_pending_filter(
    pending: DataFrame, spec: UsageFilter, aliases: DataFrame | None = None
) -> DataFrame:
    return keep_sessions(pending.where(pending_matches(spec)), spec.sessions, aliases)


def active_only(ledger_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the ledger each session currently points at."""
    active = sessions.where(F.col("active_ledger_id").isNotNull()).select(
        F.col("active_ledger_id").alias("ledger_id")
    )
    return ledger_rows.join(active, "ledger_id", "left_semi")
