"""Session logs as framed lines: exact byte positions, whole lines only.

Spark splits a large file into blocks; a block knows the order of its own lines but not
where it starts counting. Positions are therefore a chunked running sum: within a block,
then carried over the blocks of the file. No file is read by one task unless it is small.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.model import MAX_LINE_BYTES
from tallyline.operators.scan import chunked_scan

# The two folders of a source that hold logs, and the log suffix.
TREES = ("sessions", "archived_sessions")
LOG_GLOB = "*.jsonl"


def raw_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with file, file size, block start and an order number inside the block.

    The separator is fixed to a line feed: with automatic detection a carriage return would
    vanish from the value and shift every later position.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", LOG_GLOB)
        .text(list(paths))
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_order"),
        )
    )


def framed(lines: DataFrame) -> DataFrame:
    """path, byte_offset, byte_end, content_hash, line and oversized, for finished lines only.

    A last line without its line feed ends past the file and is left for the next read.
    """
    scanned = chunked_scan(
        lines,
        ["path"],
        "block_start",
        ["line_order"],
        sums={"byte_end": "CAST(octet_length(value) + 1 AS BIGINT)"},
    ).where("byte_end <= file_size")
    return scanned.selectExpr(
        "path",
        "file_size",
        "byte_end - octet_length(value) - 1 AS byte_offset",
        "byte_end",
        "xxhash64(value) AS content_hash",  # of the whole line, however long
        f"octet_length(value) > {MAX_LINE_BYTES} AS oversized",
        f"CASE WHEN octet_length(value) <= {MAX_LINE_BYTES} THEN"
        " CASE WHEN endswith(value, '\\r') THEN left(value, length(value) - 1) ELSE value END END AS line",
    )


def tree_outcomes(spark: SparkSession, *roots: str) -> list[tuple[str, str, str]]:
    """(root, tree path, readable | missing | unreadable) of the log trees of source roots."""
    found = []
    for root in roots:
        for tree in TREES:
            name = f"{root.rstrip('/')}/{tree}"
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            try:
                files = path.getFileSystem(spark._jsc.hadoopConfiguration())
                state = "readable" if files.exists(path) and files.listStatus(path) is not None else "missing"
            except Py4JJavaError:  # no permission, or the store does not answer
                state = "unreadable"
            found.append((root, name, state))
    return found


def read_logs(spark: SparkSession, *roots: str) -> DataFrame:
    """Framed lines of the log trees of one or more source roots that can be read; what became
    of every tree is in ``tree_outcomes``."""
    trees = [name for _, name, state in tree_outcomes(spark, *roots) if state == "readable"]
    if not trees:
        return framed(spark.createDataFrame([], "value string, path string, file_size long, block_start long, line_order long"))
    return framed(raw_lines(spark, *trees))


def since(lines: DataFrame, committed: DataFrame) -> DataFrame:
    """Lines from each file's committed offset up to its pinned size.

    ``committed`` holds (path, committed_offset, upper_bound); unknown files start at zero.
    """
    joined = lines.join(committed, "path", "left")
    start, end = F.coalesce("committed_offset", F.lit(0)), F.coalesce("upper_bound", F.lit(2**62))
    return joined.where((F.col("byte_offset") >= start) & (F.col("byte_end") <= end)).select(*lines.columns)
