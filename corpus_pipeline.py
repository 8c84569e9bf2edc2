"""A training-corpus pipeline out of the text operators.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns a DataFrame;
all but the last return the columns of ``documents``. Stages are meant to be written and read
again between each other, as ``run`` does, so a lost executor never replays more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm import decontaminate, near_copies, secrets, sentence_pieces, toxicity
from tallyline.llm.common import read, stored
from tallyline.llm.queries import vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; without evidence in the labels all stay."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    if not model.weights:
        return docs
    scored = docs.select(*docs.columns, toxicity.score_of(F.col("text"), model).alias("__score"))
    return scored.where(F.col("__score") < 0.5).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, stored so that it stays. Ids may be NULL or repeated."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts link at 0.8 of their 5-word shingles, the one with the least id stays;
    of rows with the same id one does, and a NULL id comes after all others."""
    rows = keyed(docs)
    named = near_copies.components(rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    named = stored(named.select("row", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("order")), "pipeline-groups")
    first = named.groupBy("component").agg(F.min("order")["row"].alias("first"))
    gone = named.join(first, "component").where("row <> first").select(F.col("row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go, whatever their ids; others of the same id stay."""
    rows = keyed(docs)
    found = decontaminate.contaminated_pairs(rows.select(F.col("__row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id").alias("__row")).distinct()
    return rows.join(found, "__row", "left_anti").select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; every document stays. n_chars follows the text."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip of every document."""
    return sentence_pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", benchmark_out),
    ("secret_scans", secrets_masked),
    ("sentence_pieces", encoded),
]

# Fingerprints, compression lengths and piece merging are not SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
