"""Composite answers: each is a few lazy DataFrames over one filtered view.

``Model`` bundles the tables an answer reads. An answer returns named DataFrames; nothing is
collected here, and parts nobody reads are never computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tallyline.operators import calendar, catalog, coverage, facets, filters, groups, measures, pages, pricing, series, sessions
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.session import cut_sizes


@dataclass
class Model:
    usage: Callable[[int | None, int | None], DataFrame]  # events of a range, the bounds pushed into the scan
    sessions: DataFrame
    aliases: DataFrame
    projects: DataFrame
    sources: DataFrame
    files: DataFrame
    generations: DataFrame
    scan_files: DataFrame
    scan_state: DataFrame
    pending: DataFrame
    contexts: DataFrame
    diagnostics: DataFrame  # merged problems
    ledgers: DataFrame
    rules: DataFrame
    rate_aliases: DataFrame
    revision: int
    publications: DataFrame | None = None  # rate catalogs by revision; they refine what the rules decide

    @classmethod
    def of(cls, tables, rules: DataFrame, rate_aliases: DataFrame, revision: int, publications: DataFrame | None = None) -> "Model":
        names = ("usage", "sessions", "aliases", "projects", "sources", "files", "generations", "scan_files", "scan_state", "pending", "contexts", "ledgers")
        merged = coverage.deduplicated_diagnostics(tables.diagnostics)
        return cls(**{n: getattr(tables, n) for n in names}, diagnostics=merged, rules=rules, rate_aliases=rate_aliases, revision=revision, publications=publications)


class Answer:
    """Shared parts of the answers to one filter."""

    def __init__(self, model: Model, spec: UsageFilter, specified_ms: int | None = None):
        self.model, self.spec, self.specified_ms = model, spec.validate(), specified_ms

    @cached_property
    def facts(self) -> DataFrame:
        ranged = self.model.usage(self.spec.start_ms, self.spec.end_ms)
        return filters.apply_filter(ranged, self.spec, self.model.aliases)

    @cached_property
    def pending(self) -> DataFrame:
        return filters.apply_pending_filter(self.model.pending, self.spec, self.model.aliases)

    @cached_property
    def priced(self) -> DataFrame:
        return self.price(self.facts)

    def price(self, facts: DataFrame) -> DataFrame:
        m = self.model
        if m.publications is None:
            return pricing.price_events(facts, m.rules, m.rate_aliases, m.revision, self.specified_ms)
        chosen = pricing.select_rules(catalog.with_request_evidence(facts), m.rules, m.rate_aliases, m.revision, self.specified_ms)
        return pricing.with_outcome(catalog.with_catalog(chosen, m.publications, m.revision))

    @cached_property
    def summary(self) -> DataFrame:
        return measures.totals(self.facts)

    @cached_property
    def pricing(self) -> DataFrame:
        return pricing.pricing_summary(self.priced)

    @cached_property
    def coverage(self) -> DataFrame:
        m, selection = self.model, self.spec.sources
        row = coverage.coverage(
            coverage.gap_counts(self.pending),
            coverage.pending_file_identities(m.files, m.generations, m.scan_files, m.scan_state, m.sources, selection),
            coverage.source_issues(m.sources, m.scan_state, m.scan_files, m.files, m.generations, selection),
            coverage.format_issues(m.diagnostics, selection),
        )
        return row

    @cached_property
    def versions(self) -> DataFrame:
        used = self.facts.select("ledger_id").distinct()
        return self.model.ledgers.join(used, "ledger_id", "left_semi").select("parser_version", "accounting_version").distinct()

    def series(self, grain: str) -> DataFrame:
        """Series with gap counts and state of each bucket."""
        bins = calendar.buckets(self.spec.start_ms, self.spec.end_ms, self.spec.timezone, grain)
        totals = series.zero_fill(measures.totals_by(series.with_bucket(self.facts, bins), ["bucket_index"]), bins)
        gaps = coverage.gap_series(self.pending, bins).drop("start_ms")
        states = coverage.series_state(gaps, self.coverage)
        # At most 2000 buckets on every side.
        return totals.join(gaps, "bucket_index").join(states, "bucket_index").withColumn(
            "breakdown_complete", F.expr(coverage.breakdown_complete())
        )


def header(answer: Answer) -> DataFrame:
    """Summary, pricing and coverage of a filter in one row; refuses to differ in tokens."""
    row = answer.summary
    for side in (answer.pricing, answer.coverage):
        row = row.join(F.broadcast(side), F.lit(True))  # one row each
    checked = (
        "CASE WHEN priced_total_tokens + unpriced_total_tokens <> total_tokens"
        " THEN CAST(raise_error('priced and unpriced tokens differ from the total') AS DECIMAL(38,0)) ELSE total_tokens END"
    )
    return row.withColumns({"total_tokens": F.expr(checked), "breakdown_complete": F.expr(coverage.breakdown_complete())})


def dashboard(model: Model, spec: UsageFilter, grain: str, heatmap: tuple[int, int], specified_ms: int | None = None) -> dict[str, DataFrame]:
    answer = Answer(model, spec, specified_ms)
    from dataclasses import replace

    heat = Answer(model, replace(spec, start_ms=heatmap[0], end_ms=heatmap[1]), specified_ms)
    return {
        "header": header(answer),
        "series": answer.series(grain),
        "heatmap": series.heat_levels(heat.series("day")),
        "recent_sessions": recent_sessions(answer),
        "versions": answer.versions.unionByName(heat.versions).distinct(),
    }


def _settled_page(found: DataFrame) -> DataFrame:
    """The rows of a page (at most 201), written once: all further parts of an answer start from
    them instead of finding the page again."""
    return cut_sizes(found)


def _page_pricing(answer: Answer, rows: DataFrame, key: str) -> DataFrame:
    """Pricing of the groups on a page: only their events are priced."""
    keys = F.broadcast(rows.select(key))  # a page: at most 201 rows
    return pricing.pricing_summary(answer.price(answer.facts.join(keys, key, "left_semi")), [key])


def recent_sessions(answer: Answer, limit: int = 10) -> DataFrame:
    """The ten sessions with the newest events. They are found first; only they are summed."""
    newest = answer.facts.groupBy("session_key").agg(F.expr("max(occurred_at_ms) AS latest_at_ms"))
    found = _settled_page(newest.orderBy(F.desc("latest_at_ms"), F.asc("session_key")).limit(limit))
    mine = answer.facts.join(F.broadcast(found.select("session_key")), "session_key", "left_semi")
    rows = sessions.session_totals(mine)
    m = answer.model
    described = sessions.describe_sessions(rows, mine, m.sessions, m.aliases, m.projects)
    return described.join(_page_pricing(answer, found, "session_key"), "session_key")


def grouped(model: Model, spec: UsageFilter, dimension: str, sort: str, limit: int, specified_ms: int | None = None) -> dict[str, DataFrame]:
    answer = Answer(model, spec, specified_ms)
    if dimension == "models":
        rows, key = groups.by_models(answer.facts), "model_key"
    else:
        rows, key = groups.by_projects(answer.facts, model.projects), "project_id"
    prices = pricing.pricing_summary(answer.priced, [key]).withColumnRenamed(key, "dimension_key")
    gaps = coverage.gap_counts(answer.pending, [key]).withColumnRenamed(key, "dimension_key")
    shown = groups.ordered(rows, sort, limit)
    joined = _null_safe(_null_safe(shown, prices, "inner"), gaps, "left")
    base = answer.coverage.selectExpr("pending_file_count AS f", "known_gap AS g", "format_issue_count AS x", "source_issue_count AS s", "selected_sources AS n")
    state = (
        "CASE WHEN coalesce(pending_observation_count, 0) > 0 OR coalesce(unattributed_observation_count, 0) > 0 OR f > 0 OR g OR x > 0 THEN 'partial'"
        " WHEN n > 0 AND s = 0 THEN 'complete' ELSE 'unknown' END"
    )
    return {
        "header": header(answer),
        "groups": joined.join(F.broadcast(base), F.lit(True)).withColumn("state", F.expr(state)).drop("f", "g", "x", "s", "n"),
        "count": groups.group_count(answer.facts, [key], limit),
        "versions": answer.versions,
    }


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on dimension_key with the unknown group meeting the unknown group."""
    other = right.withColumnRenamed("dimension_key", "other_key")
    return left.join(other, F.col("dimension_key").eqNullSafe(F.col("other_key")), how).drop("other_key")


def facet(model: Model, spec: UsageFilter, dimension: str, search: str, size: int, position: str | None = None, started: bool = False) -> DataFrame:
    """One page of choices of a dimension, counted without that dimension's own selection."""
    filters.validate_page(size, search)
    facts = Answer(model, spec.without(dimension)).facts
    options = {
        "models": lambda: facets.model_options(facts),
        "projects": lambda: facets.project_options(facts, model.projects),
        "sessions": lambda: facets.session_options(facts, model.sessions),
        "sources": lambda: facets.source_options(facts, model.sources),
    }[dimension]()
    return pages.key_page(facets.searched(options, search), "dimension_key", size, position, started)


def sessions_page(model: Model, spec: UsageFilter, sort: str, size: int, position: tuple | None = None, specified_ms: int | None = None) -> dict[str, DataFrame]:
    answer = Answer(model, spec, specified_ms)
    order = {"latest_desc": "latest_at_ms", "total_desc": "total_tokens"}[sort]
    found = _settled_page(pages.page(sessions.session_totals(answer.facts), order, "session_key", size, position))
    described = sessions.describe_sessions(found, answer.facts, model.sessions, model.aliases, model.projects)
    contexts = sessions.latest_context(
        model.contexts.join(F.broadcast(found.select("session_key")), "session_key", "left_semi")
    )
    gaps = coverage.gap_counts(answer.pending.join(F.broadcast(found.select("session_key")), "session_key", "left_semi"), ["session_key"])
    rows = (
        described.join(_page_pricing(answer, found, "session_key"), "session_key")
        .join(contexts, "session_key", "left")
        .join(gaps, "session_key", "left")
    )
    return {"header": header(answer), "sessions": rows, "versions": answer.versions}


def _within_session(model: Model, spec: UsageFilter, session_key: str) -> UsageFilter:
    """The filter cut down to one session; empty when the filter does not admit it."""
    from dataclasses import replace

    if spec.sessions.is_all:
        return replace(spec, sessions=Selection.of(session_key))
    wanted = filters.canonical_ids(model.sessions, (session_key,), model.aliases).collect()[0][0]  # one key
    admitted = {r[0] for r in filters.canonical_ids(model.sessions, spec.sessions.ids, model.aliases).collect()}  # up to 100
    return replace(spec, sessions=Selection.of(*([wanted] if wanted in admitted else [])))


def session_detail(model: Model, spec: UsageFilter, session_key: str, specified_ms: int | None = None) -> dict[str, DataFrame]:
    answer = Answer(model, _within_session(model, spec, session_key), specified_ms)
    one = Selection.of(session_key)
    identity = filters.keep_sessions(sessions.published(model.sessions), one, model.aliases)
    names = identity.select("session_key", F.coalesce("provider_session_id", "session_key").alias("display_name"), "parent_provider_id")
    below = sessions.children(model.sessions, model.aliases)
    mine = filters.keep_sessions(below, one, model.aliases)
    lifetime = filters.keep_sessions(model.pending, one, model.aliases)
    return {
        "identity": names.join(sessions.parents(model.sessions, model.aliases), "session_key", "left"),
        "header": header(answer),
        "activity": pages.latest_by(answer.facts, ["session_key"], "occurred_at_ms", "event_id", ["model", "project_id"]),
        "context": sessions.latest_context(filters.keep_sessions(model.contexts, one, model.aliases)),
        "children": mine.select("child_key").orderBy("child_key").limit(100),
        "child_count": mine.agg(F.expr("count(1) AS child_count"), F.expr("count(1) > 100 AS children_truncated")),
        "classifications": sessions.classifications(lifetime, []),
    }


def turns_page(model: Model, spec: UsageFilter, session_key: str, size: int, position: tuple | None = None, specified_ms: int | None = None) -> dict[str, DataFrame]:
    answer = Answer(model, _within_session(model, spec, session_key), specified_ms)
    found = _settled_page(pages.page(sessions.turn_totals(answer.facts), "last_at_ms", "turn_id", size, position))
    return {
        "header": header(answer),
        "turns": found.join(_page_pricing(answer, found, "turn_id"), "turn_id"),
        "unidentified": sessions.unidentified_events(answer.facts),
        "versions": answer.versions,
    }


def events_page(model: Model, spec: UsageFilter, sort: str, size: int, position: tuple | None = None, specified_ms: int | None = None) -> dict[str, DataFrame]:
    """Events with source, price and the rule that decided. The page is cut before pricing."""
    answer = Answer(model, spec, specified_ms)
    order = {"time_desc": "occurred_at_ms", "total_desc": "total_tokens"}[sort]
    found = pages.page(answer.facts, order, "event_id", size, position)
    priced = pricing.with_cost(answer.price(found))
    priced = catalog.explanation(priced if model.publications is not None else priced.withColumn("selection", F.lit("rule")))
    names = model.sessions.select("session_key", F.coalesce("provider_session_id", "session_key").alias("session_display_name"))
    labels = model.projects.select("project_id", F.coalesce("user_alias", "display_name").alias("project_display_name"))
    return {
        "header": header(answer),
        "events": priced.join(names, "session_key").join(labels, "project_id", "left"),
        "versions": answer.versions,
    }


def context_of(model: Model, session_key: str) -> DataFrame:
    """Latest context of a session; one row of unknowns when there is none."""
    known = sessions.latest_context(filters.keep_sessions(model.contexts, Selection.of(session_key), model.aliases))
    asked = known.sparkSession.createDataFrame([(session_key,)], "asked string")
    return asked.join(known, F.lit(True), "left").withColumn("quality", F.coalesce("quality", F.lit("unknown")))


def small_scope(model: Model, zone: str, scope: str, now_ms: int, session_key: str | None = None, started_ms: int | None = None) -> dict[str, DataFrame]:
    start, end = calendar.small_scope_range(zone, scope, now_ms, started_ms)
    chosen = Selection.of(session_key) if session_key else Selection()
    answer = Answer(model, UsageFilter(start, end, zone, sessions=chosen))
    return {"header": header(answer), "versions": answer.versions}
