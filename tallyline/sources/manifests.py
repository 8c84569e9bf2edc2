"""File manifests: content digests, and what happened to each file between two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SEGMENT_BYTES = 8 * 1024 * 1024


def segment_digests(lines: DataFrame) -> DataFrame:
    """Digest per (path, segment) of framed lines.

    Position and content of every line go into a sum of hashes, so a file of any size is
    digested by as many tasks as it has blocks, in whatever order they finish.
    """
    return lines.groupBy("path", F.expr(f"byte_offset div {SEGMENT_BYTES} AS segment")).agg(
        F.expr("count(1) AS lines"),
        F.expr("sum(CAST(xxhash64(byte_offset, content_hash) AS DECIMAL(38,0))) AS digest"),
    )


def committed_digests(lines: DataFrame, committed: DataFrame) -> DataFrame:
    """Digest of each file up to its committed offset: equal to the stored one unless rewritten."""
    inside = lines.join(committed.select("path", "committed_offset"), "path").where("byte_end <= committed_offset")
    return segment_digests(inside).groupBy("path").agg(
        F.expr("sum(lines) AS lines"), F.expr("CAST(sum(digest) AS STRING) AS digest")
    )


CHANGE = """CASE
WHEN now_path IS NULL THEN CASE WHEN other_identity IS NOT NULL THEN 'superseded' ELSE 'missing' END
WHEN old_path IS NULL THEN CASE WHEN former_identity IS NOT NULL THEN 'replaced' ELSE 'new' END
WHEN now_size < old_size OR NOT (known_anchors <=> old_anchors) THEN 'replaced'
WHEN now_path <> old_path THEN 'moved' WHEN now_size > old_size THEN 'appended' ELSE 'same' END"""


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change class of each file identity of a source between two manifests.

    ``before``: source_id, identity, path, size, anchors. ``after`` also has known_anchors:
    the digest of the part the older manifest covers. replaced means a new generation.
    """
    old = before.selectExpr("source_id", "identity", "path AS old_path", "size AS old_size", "anchors AS old_anchors")
    now = after.selectExpr("source_id", "identity", "path AS now_path", "size AS now_size", "known_anchors")
    joined = old.join(now, ["source_id", "identity"], "full")
    taken = after.selectExpr("source_id", "path AS old_path", "identity AS other_identity")
    held = before.selectExpr("source_id", "path AS now_path", "identity AS former_identity")
    return (
        joined.join(taken, ["source_id", "old_path"], "left")
        .join(held, ["source_id", "now_path"], "left")
        .selectExpr("source_id", "identity", "old_path", "now_path", f"{CHANGE} AS change")
    )


def discovered_roots(candidates: DataFrame) -> DataFrame:
    """One candidate per canonical root: explicit before environment before default."""
    rank = "CASE origin WHEN 'explicit' THEN 0 WHEN 'environment' THEN 1 ELSE 2 END"
    best = candidates.groupBy("root_key").agg(F.expr(f"min_by(struct(root_path, origin), struct({rank}, root_path)) AS best"))
    return best.select("root_key", "best.*")


def register_source(registry: DataFrame, source_id: str, root_key: str, root_path: str, limit: int = 32) -> DataFrame:
    """Add a source, or resume the one that already has the directory; removed ones come back."""
    same = F.col("root_key") == root_key
    if not registry.where(same).isEmpty():
        return registry.withColumns(
            {"enabled": same | F.col("enabled"), "removed": ~same & F.col("removed"), "root_path": F.when(same, F.lit(root_path)).otherwise(F.col("root_path"))}
        )
    if registry.where("NOT removed").limit(limit).count() >= limit:
        raise ValueError(f"at most {limit} sources")
    row = registry.sparkSession.createDataFrame(
        [(source_id, root_key, root_path, True, False)],
        "source_id string, root_key string, root_path string, enabled boolean, removed boolean",
    )
    return registry.unionByName(row)


def set_source(registry: DataFrame, source_id: str, *, enabled: bool, removed: bool = False) -> DataFrame:
    """Pause, resume or remove a source; its facts are kept."""
    mine = F.col("source_id") == source_id
    return registry.withColumns(
        {"enabled": F.when(mine, F.lit(enabled)).otherwise(F.col("enabled")), "removed": F.when(mine, F.lit(removed)).otherwise(F.col("removed"))}
    )
