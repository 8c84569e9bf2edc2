"""Coverage: what the totals of a filter cannot say, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import vectors as V
from tallyline.model import MAX_SOURCES, MEASURES
from tallyline.operators.calendar import Bucket
from tallyline.operators.filters import Selection
from tallyline.operators.series import bucket_table, with_bucket
from tallyline.session import require_at_most

# Source issues that prove something is missing, whatever the totals say.
GAP_CODES = (
    "source_paused",
    "source_unreadable",
    "source_partially_readable",
    "source_scan_incomplete",
    "source_scan_pending",
)


def gap_rows(pending: DataFrame) -> DataFrame:
    """Pending and unattributed observations, once each, with their provable total."""
    return (
        pending.where(F.col("kind").isin("pending", "unattributed"))
        .groupBy("observation_id", "kind", "observed_at_ms")
        .agg(F.expr(f"max(CASE WHEN kind = 'unattributed' THEN {V.usage_vector_total('vector_json')} END) AS tokens"))
    )


GAP_AGGREGATES = (
    "count_if(kind = 'pending') AS pending",
    "count_if(kind = 'unattributed') AS unattributed",
    "sum(CAST(CASE WHEN kind = 'unattributed' THEN tokens END AS DECIMAL(38,0))) AS known_tokens",
    "coalesce(bool_or(kind = 'unattributed' AND tokens IS NULL), false) AS missing",
)
UNATTRIBUTED_TOKENS = "CASE WHEN unattributed > 0 AND NOT missing THEN known_tokens END"


def gap_counts(pending: DataFrame, keys: list[str] = []) -> DataFrame:
    """Pending and unattributed counts; unattributed tokens are unknown if any one is."""
    rows = pending.where(F.col("kind").isin("pending", "unattributed"))
    per_observation = (
        rows.groupBy(*keys, "observation_id", "kind")
        .agg(F.expr(f"max({V.usage_vector_total('vector_json')}) AS tokens"))
    )
    counted = per_observation.groupBy(*keys).agg(*[F.expr(a) for a in GAP_AGGREGATES])
    return counted.selectExpr(
        *keys,
        "pending AS pending_observation_count",
        "unattributed AS unattributed_observation_count",
        f"{UNATTRIBUTED_TOKENS} AS unattributed_total_tokens",
    )


def bad_scan_entries(scan_files: DataFrame, files: DataFrame, generations: DataFrame) -> DataFrame:
    """Entries of a scan that are not confirmed at the file's current generation and size."""
    f = files.select(
        "file_id",
        F.col("source_id").alias("f_source"),
        F.col("canonical_path").alias("f_path"),
        "current_generation_id",
    )
    g = generations.selectExpr(
        "file_generation_id", "state", "checkpoint_revision AS g_revision", "observed_size", "committed_offset",
        "true AS generation_found",
    )
    joined = scan_files.join(f, "file_id", "left").join(g, "file_generation_id", "left")
    confirmed = (
        "generation_found AND state = 'current' AND current_generation_id <=> file_generation_id"
        " AND f_source <=> source_id AND f_path <=> canonical_path AND g_revision <=> checkpoint_revision"
        " AND observed_size <=> upper_bound AND committed_offset <=> upper_bound"
    )
    return joined.where(F.expr(f"NOT coalesce({confirmed}, false)")).select(*scan_files.columns)


def pending_file_identities(
    files: DataFrame, generations: DataFrame, scan_files: DataFrame, scan_state: DataFrame, sources: DataFrame,
    selection: Selection = Selection(),
) -> DataFrame:
    """Files with unread bytes or without proof, known by id, else by path; each once."""
    g = generations.selectExpr(
        "file_generation_id AS current_generation_id", "state", "committed_offset", "observed_size", "true AS found"
    )
    read = "found AND state = 'current' AND committed_offset >= observed_size AND status IN ('present', 'known')"
    unread = files.join(g, "current_generation_id", "left").where(F.expr(f"NOT coalesce({read}, false)"))
    current = scan_files.join(scan_state, ["source_id", "scan_revision"], "left_semi").join(
        _same_root(scan_state, sources), "source_id", "left_semi"
    )
    unproven = bad_scan_entries(current, files, generations)
    identity = "CASE WHEN file_id IS NULL THEN concat('path:', canonical_path) ELSE concat('file:', file_id) END AS identity"
    both = unread.selectExpr("source_id", "concat('file:', file_id) AS identity").unionByName(
        unproven.selectExpr("source_id", identity)
    )
    return both.where(selection.matches(F.col("source_id"))).distinct()


def _same_root(scan_state: DataFrame, sources: DataFrame) -> DataFrame:
    roots = sources.selectExpr("source_id", "root_path AS source_root")
    return scan_state.join(roots, ["source_id", "source_root"], "left_semi")


SOURCE_CODE = """CASE
WHEN NOT enabled OR readability = 'disabled' THEN 'source_paused'
WHEN readability = 'awaiting_directory' THEN 'source_awaiting_directory'
WHEN readability = 'partially_readable' THEN 'source_partially_readable'
WHEN readability = 'unreadable' THEN 'source_unreadable'
WHEN scan_source_state IS NULL OR NOT coalesce(source_root = root_path, false) THEN 'scan_evidence_missing'
WHEN issue_code IS NOT NULL THEN 'source_scan_incomplete'
WHEN scan_source_state = 'interrupted' THEN 'source_scan_interrupted'
WHEN invalidated THEN 'source_scan_changed'
WHEN NOT coalesce(discovery_complete, false) THEN 'source_scanning'
WHEN has_pending THEN 'source_scan_pending'
WHEN scan_source_state <> 'ready' THEN 'source_scan_incomplete' END"""
# A scan issue counts as a proven gap; a scan that merely did not get ready does not.
SOURCE_GAP = """(code IN ('source_paused', 'source_partially_readable', 'source_unreadable', 'source_scan_pending')
OR (code = 'source_scan_incomplete' AND issue_code IS NOT NULL))"""


def source_issues(
    sources: DataFrame, scan_state: DataFrame, scan_files: DataFrame, files: DataFrame, generations: DataFrame,
    selection: Selection = Selection(),
) -> DataFrame:
    """One row per selected source: its issue code (NULL when fine) and whether it proves a gap."""
    bad = bad_scan_entries(scan_files, files, generations).select("source_id", "scan_revision").distinct()
    state = scan_state.withColumnRenamed("state", "scan_source_state").join(
        bad.withColumn("has_pending", F.lit(True)), ["source_id", "scan_revision"], "left"
    )
    selected = require_at_most(sources, MAX_SOURCES, "the source registry").where(selection.matches(F.col("source_id")))
    return (
        selected.join(state, "source_id", "left")
        .withColumn("code", F.expr(SOURCE_CODE))
        .selectExpr("source_id", "code", "last_success_ms", f"coalesce({SOURCE_GAP}, false) AS is_gap")
    )


def format_issues(diagnostics: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Unresolved format problems per parser version."""
    return (
        diagnostics.where((F.col("code") == "UNSUPPORTED_FORMAT") & ~F.col("resolved"))
        .where(selection.matches(F.col("source_id")))
        .groupBy(F.expr("coalesce(parser_version, 'unknown') AS format"))
        .agg(F.expr("sum(CAST(occurrences AS DECIMAL(38,0))) AS count"))
    )


def breakdown_complete() -> str:
    return "(" + " AND ".join(f"{m}_complete" for m in MEASURES) + ")"


STATE = """CASE WHEN pending_observation_count > 0 OR unattributed_observation_count > 0 OR pending_file_count > 0
OR known_gap OR format_issue_count > 0 THEN 'partial'
WHEN selected_sources > 0 AND source_issue_count = 0 THEN 'complete' ELSE 'unknown' END"""


def coverage(gaps: DataFrame, pending_files: DataFrame, issues: DataFrame, formats: DataFrame) -> DataFrame:
    """The coverage row of one filter. Every input here is an aggregate or a bounded list."""
    one_row = [
        pending_files.agg(F.expr("count(1) AS pending_file_count")),
        issues.agg(
            F.expr("count(1) AS selected_sources"),
            F.expr("count(code) AS source_issue_count"),
            F.expr("coalesce(bool_or(is_gap), false) AS known_gap"),
            F.expr("sort_array(collect_list(CASE WHEN code IS NOT NULL THEN concat(source_id, '=', code) END)) AS source_issues"),
        ),
        formats.agg(
            F.expr("count(1) AS format_issue_count"),
            F.expr("sort_array(collect_list(concat(format, '=', count))) AS format_issues"),
        ),
    ]
    result = gaps
    for side in one_row:
        result = result.join(F.broadcast(side), F.lit(True))
    return result.withColumn("state", F.expr(STATE))


def gap_series(pending: DataFrame, bins: list[Bucket]) -> DataFrame:
    """Gap counts per bucket: dated gaps in their own bucket, undated ones in every bucket."""
    rows = gap_rows(pending)
    dated = with_bucket(rows.where(F.col("observed_at_ms").isNotNull()), bins, "observed_at_ms")
    per_bucket = dated.groupBy("bucket_index").agg(*[F.expr(a) for a in GAP_AGGREGATES])
    undated = rows.where(F.col("observed_at_ms").isNull()).agg(*[F.expr(a) for a in GAP_AGGREGATES])
    everywhere = undated.selectExpr(
        "pending AS u_pending", "unattributed AS u_unattributed", "known_tokens AS u_tokens", "missing AS u_missing"
    )
    table = bucket_table(pending.sparkSession, bins)
    # One aggregate row meets at most 2000 buckets.
    merged = table.join(per_bucket, "bucket_index", "left").join(F.broadcast(everywhere), F.lit(True))
    return merged.selectExpr(
        "bucket_index",
        "start_ms",
        "coalesce(pending, 0L) + u_pending AS pending",
        "coalesce(unattributed, 0L) + u_unattributed AS unattributed",
        "coalesce(known_tokens, CAST(0 AS DECIMAL(38,0))) + coalesce(u_tokens, CAST(0 AS DECIMAL(38,0))) AS known_tokens",
        "coalesce(missing, false) OR u_missing AS missing",
    ).selectExpr(
        "bucket_index",
        "start_ms",
        "pending AS pending_observation_count",
        "unattributed AS unattributed_observation_count",
        f"{UNATTRIBUTED_TOKENS} AS unattributed_total_tokens",
    )


def series_state(gaps: DataFrame, base: DataFrame) -> DataFrame:
    """Coverage state of each bucket, from the filter's coverage row and the bucket's gaps."""
    codes = ", ".join(f"'{c}'" for c in GAP_CODES)
    common = base.selectExpr(
        "state AS base_state",
        "source_issue_count",
        "(pending_file_count > 0 OR format_issue_count > 0"
        f" OR exists(source_issues, i -> split_part(i, '=', 2) IN ({codes}))) AS common_gap",
    )
    return gaps.join(F.broadcast(common), F.lit(True)).selectExpr(
        "bucket_index",
        "CASE WHEN common_gap OR pending_observation_count > 0 OR unattributed_observation_count > 0 THEN 'partial'"
        " WHEN source_issue_count = 0 AND base_state <> 'unknown' THEN 'complete' ELSE 'unknown' END AS state",
    )


def scan_ready(scan_state: DataFrame, scan_files: DataFrame, files: DataFrame, generations: DataFrame) -> DataFrame:
    """State of each source's scan after checking every listed file."""
    bad = bad_scan_entries(scan_files, files, generations).select("source_id", "scan_revision").distinct()
    checked = scan_state.join(bad.withColumn("has_bad", F.lit(True)), ["source_id", "scan_revision"], "left")
    ready = "discovery_complete AND NOT invalidated AND issue_code IS NULL AND has_bad IS NULL"
    return checked.selectExpr(
        "source_id",
        "scan_revision",
        f"CASE WHEN {ready} THEN 'ready' WHEN NOT discovery_complete THEN 'scanning' ELSE 'incomplete' END AS state",
    )


def mark_missing(files: DataFrame, scan_files: DataFrame, ready_sources: DataFrame) -> DataFrame:
    """After a complete scan, files it did not list are missing; their facts stay."""
    listed = scan_files.where(F.col("file_id").isNotNull()).select("file_id").distinct().withColumn("listed", F.lit(True))
    ready = ready_sources.select("source_id").distinct().withColumn("source_ready", F.lit(True))
    return (
        files.join(listed, "file_id", "left")
        .join(F.broadcast(ready), "source_id", "left")  # at most 32 sources
        .withColumn(
            "status",
            F.expr("CASE WHEN source_ready THEN CASE WHEN listed THEN 'present' ELSE 'missing' END ELSE status END"),
        )
        .drop("listed", "source_ready")
    )


def readability(trees: DataFrame) -> DataFrame:
    """Readability of a source from its trees: rows (source_id, outcome), outcome being
    readable, missing, unreadable, or entry_unreadable for a failure further down."""
    flags = trees.groupBy("source_id").agg(
        F.expr("bool_or(outcome = 'readable') AS some_readable"),
        F.expr("bool_or(outcome IN ('unreadable', 'entry_unreadable')) AS some_unreadable"),
    )
    return flags.selectExpr(
        "source_id",
        "CASE WHEN some_readable AND some_unreadable THEN 'partially_readable' WHEN some_readable THEN 'readable'"
        " WHEN some_unreadable THEN 'unreadable' ELSE 'awaiting_directory' END AS readability",
    )


def deduplicated_diagnostics(occurrences: DataFrame) -> DataFrame:
    """One row per problem: how often it was seen, when first and last, and where last."""
    return occurrences.groupBy("dedup_key").agg(
        F.expr("count(1) AS occurrences"),
        F.expr("min(seen_at_ms) AS first_seen_at_ms"),
        F.expr("max(seen_at_ms) AS last_seen_at_ms"),
        *[
            F.expr(f"max_by({c}, struct(seen_at_ms, byte_offset)) AS {c}")
            for c in ("code", "parser_version", "source_id", "file_generation_id", "byte_offset", "resolved")
        ],
    )


ISSUE_COLUMNS = ("origin", "identity", "source", "kind", "code", "path", "byte_offset", "sort_time")


def issue_rows(diagnostics: DataFrame, pending: DataFrame, files: DataFrame, scan_state: DataFrame, sources: DataFrame) -> DataFrame:
    """Every open problem of four kinds in one shape."""
    located = files.selectExpr(
        "current_generation_id AS file_generation_id", "canonical_path AS path", "source_id AS file_source"
    )
    records = (
        diagnostics.where(~F.col("resolved"))
        .join(located, "file_generation_id", "left")
        .where(F.expr("file_generation_id IS NULL OR (file_source IS NOT NULL AND (source_id IS NULL OR source_id = file_source))"))
        .selectExpr(
            "'diagnostic' AS origin", "dedup_key AS identity", "coalesce(source_id, file_source) AS source",
            "'log_record' AS kind", "code", "path", "byte_offset", "last_seen_at_ms AS sort_time",
        )
    )
    usage = (
        pending.where(F.col("kind").isin("pending", "unattributed"))
        .join(located, "file_generation_id")
        .selectExpr(
            "'usage' AS origin", "pending_id AS identity", "file_source AS source",
            "CASE kind WHEN 'pending' THEN 'unconfirmed_usage' ELSE 'unattributed_usage' END AS kind",
            "CAST(NULL AS STRING) AS code", "path", "byte_offset", "observed_at_ms AS sort_time",
        )
    )
    nothing = ("CAST(NULL AS BIGINT) AS byte_offset", "CAST(NULL AS BIGINT) AS sort_time")
    missing = files.where(F.col("status") == "missing").selectExpr(
        "'file' AS origin", "file_id AS identity", "source_id AS source", "'missing_file' AS kind",
        "CAST(NULL AS STRING) AS code", "canonical_path AS path", *nothing,
    )
    scans = (
        scan_state.where(F.col("issue_code").isNotNull())
        .join(sources.where(F.col("enabled")).selectExpr("source_id", "root_path AS source_root"), ["source_id", "source_root"])
        .selectExpr(
            "'scan' AS origin", "source_id AS identity", "source_id AS source", "'directory_scan' AS kind",
            "issue_code AS code", "source_root AS path", *nothing,
        )
    )
    return records.unionByName(usage).unionByName(missing).unionByName(scans)


def newest_issues(issues: DataFrame) -> DataFrame:
    """The newest problem of each (source, kind, code, path)."""
    from tallyline.operators.pages import _reversed

    keys = ["source", "kind", "code", "path"]
    # A missing time ranks below every time, as it does in a descending order with nulls last.
    order = f"struct(coalesce(sort_time, {-(2**62)}), {_reversed('identity')})"
    picked = issues.groupBy(*keys).agg(F.expr(f"max_by(struct(origin, identity, byte_offset, sort_time), {order}) AS row"))
    return picked.select("row.origin", "row.identity", *keys, "row.byte_offset", "row.sort_time")


def issue_list(issues: DataFrame, limit: int = 20) -> DataFrame:
    """The first problems to show, newest first, plus one probe row when there are more."""
    return (
        newest_issues(issues)
        .orderBy(F.desc_nulls_last("sort_time"), F.asc("origin"), F.asc("identity"))
        .limit(limit + 1)
        .withColumn("issue_id", F.sha2(F.concat_ws(":", "origin", "identity"), 256))
    )
