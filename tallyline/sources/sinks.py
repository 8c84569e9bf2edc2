"""Writing the tables of the model.

Facts are written by UTC day and clustered by session; a batch is written under its own
number, so writing the same batch again replaces it and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.model import DAY_MS


def with_day(df: DataFrame, time: str) -> DataFrame:
    """UTC day of a row; rows without a time get their own partition."""
    return df.withColumn("day", F.expr(f"date_from_unix_date(CAST(({time} - pmod({time}, {DAY_MS}L)) div {DAY_MS} AS INT))"))


def write_batch(df: DataFrame, path: str, batch_id: int, time: str | None = None) -> bool:
    """Write one batch idempotently; an empty batch writes nothing. Returns whether it wrote."""
    if df.isEmpty():
        return False
    parts = ["batch_id"]
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    if time is not None:
        rows, parts = with_day(rows, time), ["batch_id", "day"]
    # Only the partitions of this batch are replaced.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return True


def write_facts(events: DataFrame, path: str, partitions: int | None = None) -> None:
    """Compact facts by day, sorted by session inside files.

    Range partitioning samples the data, so a day or session of any size is cut evenly.
    """
    rows = with_day(events, "occurred_at_ms")
    order = ["day", "session_key", "occurred_at_ms"]
    spread = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_facts(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Facts of a range: whole days are pruned by partition, the edges by the time column."""
    facts = spark.read.parquet(path)
    if start_ms is not None:
        facts = facts.where((F.col("day") >= F.expr(f"date_from_unix_date({start_ms // DAY_MS})")) & (F.col("occurred_at_ms") >= start_ms))
    if end_ms is not None:
        facts = facts.where((F.col("day") <= F.expr(f"date_from_unix_date({(end_ms - 1) // DAY_MS})")) & (F.col("occurred_at_ms") < end_ms))
    return facts
