"""Session settings the engine relies on, and the two guards used across it."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Settings that can be changed while a session runs. UTC and ANSI are part of the
# semantics (exact epoch arithmetic, overflow raises); the rest is physical tuning.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call-site capture costs a round trip per column expression when plans are built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_SCRATCH: dict[str, str] = {}


def build_session(app: str = "tallyline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; the cluster's own submit settings win where set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go when nothing refers to them any more.
    startup = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**startup, **RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a scratch one if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    scratch = tempfile.mkdtemp(prefix="tallyline-checkpoint-")  # one process: its own folder is shared
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor never replays an iterative plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_sizes(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a table whose size is known. For jobs of many steps.

    A checkpoint hands on the size that its plan guessed. Each join multiplies the guesses of its
    sides, so after a dozen steps a plan spends its time on numbers of thousands of digits and
    never sends a small side to a large one. The tables go when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_sizes(spark: SparkSession):
    """``cut_sizes`` for a step that a session repeats any number of times: what the yielded function
    writes goes when the block ends, so nothing lazy may leave the block."""
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def cut(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "lz4").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield cut
    finally:
        _remove(spark, folder)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``cut_sizes`` wrote and that nothing lazy reads any more, and the shuffle
    files of plans that nothing refers to; left alone, these stay until the driver happens to
    collect its garbage."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if f"/tallyline-{spark.sparkContext.applicationId}/" in folder:
                _remove(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def modest_broadcasts(spark: SparkSession):
    """For steps over written rows. Plans size a table by its files, and rows of few texts and small
    numbers take more than ten times that in memory, so inside the block at most 1 MB of files is
    sent through the driver."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    if not before.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > 1 << 20:
        spark.conf.set(name, "1m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_methods(spark: SparkSession):
    """For a step whose expressions are very long, written inside the block. Whole-stage code puts
    them into one method, and the JVM never compiles a method above 8000 bytes but interprets it row
    by row. With that as the limit, such a step runs operator by operator, in methods that it compiles."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that plans know to be empty and that no task has to make."""
    nothing = spark.range(1).where("false")
    return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for tables that end with it."""
    application = spark.sparkContext.applicationId
    folder = _SCRATCH.get(application)
    if folder is None:
        folder = _SCRATCH[application] = f"{shared_dir(spark).rstrip('/')}/tallyline-{application}"
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already, and its JVM with it
        pass


def require_at_most(df: DataFrame, limit: int, what: str) -> DataFrame:
    """Prove a size bound before a table may be broadcast; reads at most limit + 1 rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return df
