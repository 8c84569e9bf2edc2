"""Hourly rollups, and answers that mix them with facts.

A rollup row holds the partial sums of one cohort: ledger, UTC hour, provider, model,
project and source set. Turns are kept beside it so that distinct turns stay exact across
hours. Full hours of sessions whose rollup is current are read from it; edge hours and all
other sessions are read from the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.model import HOUR_MS
from tallyline.operators import filters as fl
from tallyline.operators.calendar import Bucket
from tallyline.operators.measures import DEC, KNOWN_TURN, measure_sums, merge_partials, present_totals
from tallyline.operators.series import with_bucket

CACHE_VERSION = 1
COHORT = ["ledger_id", "session_key", "hour_start_ms", "provider", "model", "project_id", "sources"]


def with_cohort(facts: DataFrame) -> DataFrame:
    """Cohort columns of each fact. The provider of an unknown model is no part of it."""
    return facts.withColumns(
        {
            "hour_start_ms": F.expr(f"occurred_at_ms - pmod(occurred_at_ms, {HOUR_MS}L)"),
            "provider": F.expr("CASE WHEN model IS NOT NULL THEN provider END"),
            "sources": F.expr("concat_ws('\\n', array_sort(array_distinct(source_ids)))"),
        }
    )


def build_rollup(facts: DataFrame) -> DataFrame:
    """Partial sums per cohort and hour; partition it by day when written."""
    return measure_sums(with_cohort(facts), COHORT)


def build_turns(facts: DataFrame) -> DataFrame:
    """Which turns each cohort hour holds."""
    return with_cohort(facts).where(F.expr(KNOWN_TURN)).select(*COHORT, "turn_id").distinct()


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Write by UTC day; dynamic overwrite replaces only the days that are present."""
    days = rollup.withColumn("day", F.expr("date_from_unix_date(CAST(floor(hour_start_ms / 86400000) AS INT))"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def rollup_differences(rollup: DataFrame, facts: DataFrame) -> DataFrame:
    """Ledgers whose rollup and facts disagree on tokens or events; must be empty."""
    mine = rollup.groupBy("ledger_id").agg(F.expr("sum(total_tokens) AS tokens"), F.expr("sum(usage_event_count) AS events"))
    theirs = facts.groupBy("ledger_id").agg(
        F.expr(f"-sum(CAST(total_tokens AS {DEC})) AS tokens"), F.expr("-count(1) AS events")
    )
    both = mine.unionByName(theirs).groupBy("ledger_id").agg(F.expr("sum(tokens) AS tokens"), F.expr("sum(events) AS events"))
    return both.where("tokens <> 0 OR events <> 0")


def content_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest per key: counts and sums of two row hashes, exact and mergeable.

    The hash function passes over NULLs, so which columns are NULL is hashed beside the values.
    """
    absent = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in rows.columns])
    others = [*rows.columns, absent]
    hashed = rows.select(*keys, F.xxhash64(*others).alias("h1"), F.xxhash64(F.lit("second"), *others).alias("h2"))
    return hashed.groupBy(*keys).agg(
        F.sha2(
            F.concat_ws(
                ":",
                F.count(F.lit(1)).cast("string"),
                F.sum(F.col("h1").cast(DEC)).cast("string"),
                F.sum(F.col("h2").cast(DEC)).cast("string"),
            ),
            256,
        ).alias("digest")
    )


EVIDENCE = [
    "ledger_id", "event_id", "occurred_at_ms", "provider", "model", "project_id", "turn_id", "total_tokens", "input_total",
    "cached_input", "cache_write_input", "output_total", "reasoning_output",
]


def evidence_revisions(facts: DataFrame) -> DataFrame:
    """Revision of each ledger's facts: it changes exactly when a fact of the ledger does."""
    rows = facts.select(*EVIDENCE, F.concat_ws("\n", F.array_sort("source_ids")).alias("sources"))
    return content_digest(rows, ["ledger_id"]).withColumnRenamed("digest", "evidence_revision")


def rollup_sets(facts: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Identity of the rollup each ledger should have now."""
    parts = [F.lit(str(CACHE_VERSION)), "ledger_id", "evidence_revision", "parser_version", "accounting_version"]
    return evidence_revisions(facts).join(ledgers.select("ledger_id", "parser_version", "accounting_version"), "ledger_id").withColumn(
        "set_id", F.concat(F.lit("rollup-"), F.sha2(F.concat_ws("|", *parts), 256))
    )


def stale_ledgers(wanted: DataFrame, ready: DataFrame) -> DataFrame:
    """Ledgers without a current rollup, in building order."""
    return wanted.join(ready.select("set_id"), "set_id", "left_anti").select("ledger_id", "set_id").orderBy("ledger_id")


def superseded_sets(wanted: DataFrame, ready: DataFrame) -> DataFrame:
    """Stored rollup sets nothing asks for any more."""
    return ready.join(wanted.select("set_id"), "set_id", "left_anti")


def full_hours(start_ms: int, end_ms: int) -> tuple[int, int]:
    """Whole UTC hours inside a range; start >= end when there is none."""
    return -(-start_ms // HOUR_MS) * HOUR_MS, end_ms // HOUR_MS * HOUR_MS


def _filter_cohorts(rows: DataFrame, spec: fl.UsageFilter, aliases: DataFrame | None) -> DataFrame:
    from tallyline.functions.text import model_key

    if not spec.models.is_all:
        rows = rows.where(spec.models.matches(model_key(F.col("provider"), F.col("model"))))
    if not spec.projects.is_all:
        rows = rows.where(spec.projects.matches(F.col("project_id")))
    if not spec.sources.is_all:
        wanted = F.array(*[F.lit(s) for s in spec.sources.ids]) if spec.sources.ids else None
        rows = rows.where(F.lit(False) if wanted is None else F.arrays_overlap(F.split("sources", "\n"), wanted))
    return fl.keep_sessions(rows, spec.sessions, aliases)


def _cached_ids(rows: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    sessions = rows.select(*keys, "session_key", F.lit(None).cast("string").alias("known_turn")).distinct()
    named = turns.select(*keys, "session_key", F.col("turn_id").alias("known_turn")).distinct()
    return sessions.unionByName(named)


def hybrid_partials(
    facts: DataFrame, rollup: DataFrame, turns: DataFrame, ledgers: DataFrame, ready: DataFrame, spec: fl.UsageFilter,
    keys: list[str], aliases: DataFrame | None = None, bins: list[Bucket] | None = None,
) -> DataFrame:
    """Partial sums per group from rollup hours and remaining facts.

    ``ready`` holds the ledger_id of every one of ``ledgers`` whose rollup is current. With
    ``bins``, a rollup hour is used only if it lies inside one bucket. Facts are read in three
    disjoint parts, so that what the rollup covers is not scanned: the hours a range boundary
    cuts, full hours of ledgers without a current rollup, and hours a bucket boundary cuts.
    """
    spec.validate()
    start, end = full_hours(spec.start_ms, spec.end_ms)
    ready = ready.select("ledger_id").distinct()
    stale = ledgers.select("ledger_id").distinct().join(ready, "ledger_id", "left_anti")
    inside = f"occurred_at_ms >= {start} AND occurred_at_ms < {end}"

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.where(f"hour_start_ms >= {start} AND hour_start_ms < {end}")
        rows = _filter_cohorts(rows, spec, aliases).join(ready, "ledger_id", "left_semi")
        return _whole_hours(rows, bins) if bins else rows

    cached, cached_turns = usable(rollup), usable(turns)
    kept = fl.apply_filter(facts, spec, aliases).withColumn("provider", F.expr("CASE WHEN model IS NOT NULL THEN provider END"))
    raw = kept.where(f"NOT ({inside})").unionByName(kept.where(inside).join(stale, "ledger_id", "left_semi").select(*kept.columns))
    cut = _cut_hours(bins) if bins else []
    if cut:
        hours = kept.where(inside).withColumn("hour_start_ms", F.expr(f"occurred_at_ms - pmod(occurred_at_ms, {HOUR_MS}L)"))
        split = hours.join(F.broadcast(_hour_table(facts, cut)), "hour_start_ms", "left_semi").join(stale, "ledger_id", "left_anti")
        raw = raw.unionByName(split.select(*kept.columns))
    if bins:
        raw = with_bucket(raw, bins)

    # Sums add up; distinct ids of both sides are merged before they are counted.
    from_cache = cached.select(*keys, *[c for c in cached.columns if c not in {*COHORT, *keys}])
    sums = from_cache.unionByName(measure_sums(raw, keys))
    raw_ids = raw.selectExpr(*keys, "session_key", f"CASE WHEN {KNOWN_TURN} THEN turn_id END AS known_turn").distinct()
    ids = _cached_ids(cached, cached_turns, keys).unionByName(raw_ids).distinct()
    per_session = ids.groupBy(*dict.fromkeys([*keys, "session_key"])).agg(F.expr("count(known_turn) AS turns"))
    counts = per_session.groupBy(*keys).agg(F.expr("count(session_key) AS session_count"), F.expr("sum(turns) AS turn_count"))
    return sums.unionByName(counts, allowMissingColumns=True)


def _cut_hours(bins: list[Bucket]) -> list[int]:
    """UTC hours that a bucket boundary cuts (at most two per bucket)."""
    edges = {b for x in bins for b in (x.start_ms, x.end_ms) if b % HOUR_MS}
    return sorted({e // HOUR_MS * HOUR_MS for e in edges})


def _hour_table(like: DataFrame, hours: list[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(h,) for h in hours], "hour_start_ms long")


def _whole_hours(rows: DataFrame, bins: list[Bucket]) -> DataFrame:
    cut = _cut_hours(bins)
    if cut:
        rows = rows.join(F.broadcast(_hour_table(rows, cut)), "hour_start_ms", "left_anti")
    return with_bucket(rows, bins, "hour_start_ms")


def hybrid_totals(facts, rollup, turns, ledgers, ready, spec, keys=[], aliases=None) -> DataFrame:
    """Totals per group, equal to the totals of the facts alone."""
    partials = hybrid_partials(facts, rollup, turns, ledgers, ready, spec, keys, aliases)
    return present_totals(merge_partials(partials, keys), keys)


def hybrid_series(facts, rollup, turns, ledgers, ready, spec, bins, aliases=None) -> DataFrame:
    from tallyline.operators.series import zero_fill

    keys = ["bucket_index"]
    partials = hybrid_partials(facts, rollup, turns, ledgers, ready, spec, keys, aliases, bins)
    return zero_fill(present_totals(merge_partials(partials, keys), keys), bins)
