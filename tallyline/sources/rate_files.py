"""Rate catalog documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.model import CATALOG


def read_catalogs(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per catalog document (a JSON object with an entries list)."""
    return spark.read.schema(CATALOG).option("multiLine", "true").json(list(paths)).withColumn(
        "content_sha256", F.expr("sha2(to_json(struct(*)), 256)")
    )
