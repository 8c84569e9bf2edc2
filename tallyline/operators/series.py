"""Time series over calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions import text as X
from tallyline.model import DAY_MS, HOUR_MS
from tallyline.operators import calendar
from tallyline.operators.measures import MEASURES, totals_by

BUCKET_SCHEMA = "bucket_index int, start_ms long, end_ms long, display_label string, utc_offset string"


def bucket_table(spark: SparkSession, bins: list[calendar.Bucket]) -> DataFrame:
    rows = [(b.index, b.start_ms, b.end_ms, b.label, b.utc_offset) for b in bins]
    return spark.createDataFrame(rows, BUCKET_SCHEMA)


def _uniform_start(bins: list[calendar.Bucket]) -> tuple[int, int] | None:
    """(origin, width) when every bucket but the clipped ends has the same width."""
    if len(bins) == 1:
        return None
    width = max(b.end_ms - b.start_ms for b in bins)
    origin = bins[0].end_ms - width
    fits = all(origin + b.index * width <= b.start_ms and b.end_ms <= origin + (b.index + 1) * width for b in bins)
    inner = all(b.end_ms - b.start_ms == width for b in bins[1:-1])
    return (origin, width) if fits and inner else None


def with_bucket(facts: DataFrame, bins: list[calendar.Bucket], time: str = "occurred_at_ms") -> DataFrame:
    """Add bucket_index; rows outside every bucket are dropped.

    Buckets are contiguous, so an index is enough: arithmetic where they are equally wide,
    else an equi join on the covered UTC hour with at most a few buckets per hour. Neither
    needs a shuffle of the facts or a range comparison against every bucket.
    """
    at = F.col(time)
    facts = facts.where((at >= F.lit(bins[0].start_ms)) & (at < F.lit(bins[-1].end_ms)))
    uniform = _uniform_start(bins)
    if len(bins) == 1:
        return facts.withColumn("bucket_index", F.lit(0))
    if uniform:
        origin, width = uniform
        return facts.withColumn("bucket_index", F.floor((at - F.lit(origin)) / F.lit(width)).cast("int"))
    step = HOUR_MS if bins[-1].end_ms - bins[0].start_ms <= 2200 * DAY_MS else DAY_MS
    spark = facts.sparkSession
    # One row per (step, bucket) pair: bounded by the range limits of the calendar.
    steps = (
        bucket_table(spark, bins)
        .select("bucket_index", "start_ms", "end_ms")
        .withColumn(
            "step_start",
            F.explode(
                F.sequence(
                    F.col("start_ms") - F.pmod("start_ms", F.lit(step)),
                    F.col("end_ms") - 1,
                    F.lit(step),
                )
            ),
        )
    )
    joined = facts.withColumn("step_start", at - F.pmod(at, F.lit(step))).join(
        F.broadcast(steps), "step_start"
    )
    return joined.where((at >= F.col("start_ms")) & (at < F.col("end_ms"))).drop(
        "step_start", "start_ms", "end_ms"
    )


def zero_fill(totals: DataFrame, bins: list[calendar.Bucket]) -> DataFrame:
    """Every bucket once: an empty one has total 0, unknown measures and zero counts."""
    table = bucket_table(totals.sparkSession, bins)
    joined = table.join(totals, "bucket_index", "left")
    zero = F.lit(0)
    filled = [F.coalesce("total_tokens", zero.cast("decimal(38,0)")).alias("total_tokens")]
    for m in MEASURES:
        filled += [
            F.col(m),
            F.coalesce(f"{m}_covered", zero.cast("decimal(38,0)")).alias(f"{m}_covered"),
            F.coalesce(f"{m}_complete", F.lit(False)).alias(f"{m}_complete"),
        ]
    filled += [
        F.coalesce("session_count", zero).cast("long").alias("session_count"),
        F.coalesce("usage_event_count", zero).cast("long").alias("usage_event_count"),
        "reliable_turn_count",
        F.coalesce("reliable_turns_complete", F.lit(False)).alias("reliable_turns_complete"),
    ]
    return joined.select("bucket_index", "start_ms", "end_ms", "display_label", "utc_offset", *filled)


def series(facts: DataFrame, start_ms: int, end_ms: int, zone: str, grain: str) -> DataFrame:
    """Totals per calendar bucket of a range, gaps filled."""
    bins = calendar.buckets(start_ms, end_ms, zone, grain)
    return zero_fill(totals_by(with_bucket(facts, bins), ["bucket_index"]), bins)


def _largest(df: DataFrame) -> DataFrame:
    # Series hold at most 2000 rows, so their maximum is a fixed-size side.
    return df.join(F.broadcast(df.agg(F.max("total_tokens").alias("largest"))), F.lit(True))


def heat_levels(day_series: DataFrame) -> DataFrame:
    """Level 0..3 of each day: ceil(3 * amount / largest)."""
    amount, largest = F.col("total_tokens"), F.col("largest")
    level = F.when(amount == 0, 0).otherwise(F.ceil(amount.cast("decimal(30,0)") * 3 / largest.cast("decimal(30,0)")))
    return _largest(day_series).withColumn("heat_level", level.cast("int")).drop("largest")


def bar_heights(day_series: DataFrame) -> DataFrame:
    """Bar height in percent of the largest, cut to two places, and whether it can be stacked.

    A bar is stacked only when output, cached and noncached input are complete and make up
    the total exactly.
    """
    parts = ("output_total", "cached_input", "noncached_input")
    complete: Column = F.col("total_tokens") > 0
    total = F.lit(0).cast("decimal(38,0)")
    for part in parts:
        complete = complete & F.col(f"{part}_complete")
        total = total + F.coalesce(F.col(part), F.lit(0).cast("decimal(38,0)"))
    scaled = (F.col("total_tokens").cast("decimal(30,0)") * 10000).cast("decimal(38,0)")
    whole = X.whole_division(scaled, F.col("largest"))
    height = F.when(F.col("largest") == 0, 0.0).otherwise(whole.cast("double") / 100.0)
    return (
        _largest(day_series)
        .withColumn("bar_height", height)
        .withColumn("stacked", complete & (total == F.col("total_tokens")))
        .drop("largest")
    )
