"""Connected components of an undirected graph by alternating star operations.

Large-star joins every larger neighbour of a vertex to the smallest vertex it knows, small-star
does so for the smaller neighbours. Both keep the components and never add edges; repeated in
turn they end with one star per component, its centre the smallest vertex. Each step is a
minimum per vertex (combined before the shuffle, so a vertex with any number of links is safe)
and a join of that minimum back to the edges (a skewed vertex is split by the adaptive join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import stored


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (a, b) of long ids -> (vertex, component): the smallest id reachable.

    Vertices without a link are absent (they are their own component). Self links, repeated
    links, links in both directions and NULL ends are allowed; the last are ignored.
    """
    current = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = _fingerprint(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        current = stored(_small_star(_large_star(current)), "edges")
        previous, state = state, _fingerprint(current)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    larger = both.where("v > u")
    return larger.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has u > v here, so the smaller neighbours of u are its v.
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("c"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
