"""Embedding near-duplicates through a robust-pruned flat graph.

Vectors are compared within a label only. Equal vectors are one node. Nodes are dealt to the
``OVERLAP`` nearest of their label's centroids, so that shards overlap. In each shard a graph is
built: the nearest neighbours of every node, robustly pruned so that a neighbour is dropped if a
kept one is much nearer to it. The adjacency lists of a node from all its shards are united, and
each shard is searched over the united lists: greedy search from the shard's medoid, then range
expansion, which goes on from every node found within the threshold (and a margin below it) until
nothing new is found. Every node is a query. Found pairs are verified in double precision.

A shard that is still larger than ``SHARD_ROWS`` (very many vectors close to each other) is cut
into blocks by hash, and each pair of blocks is built and searched as a shard of its own, so that
no pair is lost to the cut and no task holds more than two blocks.

Links are counted per node with the copies behind each node, and components come from star
operations over distinct pairs; copies are never expanded into pairs.

``audit`` compares with brute force: the stated query set (ids divisible by 20) against all rows
of their labels, in blocks. Recall is measured there; the search is approximate, the check of
what it finds is exact.

Scale: centroids are fitted from at most ``SAMPLE_ROWS`` vectors per label, at most
``MAX_CENTROIDS`` over all labels, which bounds what is sent to the tasks; labels with less than
their share of rows need none. Every vector is indexed. Vectors are shuffled to their shards
twice (build, search), adjacency lists once.

Defined cases: vectors that are NULL, empty, zero, of another dimension than most, or that hold
NULL or non-finite parts, and NULL labels, link with nothing but are returned. NULL ids neither
link nor count. Repeated rows are copies: they link with each other. An empty table gives an
empty result. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import stored
from tallyline.llm.components import connected_components

THRESHOLD = 0.98
OVERLAP = 3
SHARD_ROWS = 1500
MAX_CENTROIDS = 4096
SAMPLE_ROWS = 20_000
DEGREE = 24
ALPHA = 1.2
BEAM = 32
MARGIN = 0.06  # range expansion also goes through nodes this far below the threshold
BLOCK = 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(vectors: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over rows in the given order; empty clusters keep their centre."""
    at = np.linspace(0, len(vectors) - 1, k).astype(int)
    centres = vectors[at]
    for _ in range(rounds):
        nearest = np.concatenate([(vectors[i : i + BLOCK] @ centres.T).argmax(1) for i in range(0, len(vectors), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robustly pruned neighbours of each row: (n, degree), padded with -1."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    if n < 2:
        return graph
    wide = min(n - 1, 3 * degree)
    for at in range(0, n, BLOCK):
        near = x[at : at + BLOCK] @ x.T
        rows = np.arange(len(near))
        near[rows, at + rows] = -np.inf
        top = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        gap = 2 - 2 * np.take_along_axis(near, top, 1)  # squared distance to the node
        alive = np.ones(top.shape, bool)
        filled = np.zeros(len(near), np.int64)
        for k in range(wide):
            keep = alive[:, k] & (filled < degree)
            if not keep.any():
                continue
            graph[at + rows[keep], filled[keep]] = top[keep, k]
            filled[keep] += 1
            # Drop what is much nearer to the kept neighbour than to the node.
            between = 2 - 2 * np.einsum("rkd,rd->rk", x[top[keep]], x[top[keep, k]])
            alive[keep] &= ~(alpha * alpha * between <= gap[keep])
    return graph


def search(x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Range search with every row as a query: (query, found) with cosine >= threshold."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    queries, founds = [], []
    for at in range(0, n, BLOCK):
        q = np.arange(at, min(at + BLOCK, n))
        seen = np.zeros((len(q), n), bool)
        cand = np.full((len(q), beam), -1, np.int64)
        value = np.full((len(q), beam), -np.inf)
        done = np.zeros((len(q), beam), bool)
        cand[:, 0], value[:, 0] = medoid, x[q] @ x[medoid]
        seen[:, medoid] = True
        active = np.arange(len(q))
        while len(active):
            open_value = np.where(done[active] | (cand[active] < 0), -np.inf, value[active])
            best = open_value.argmax(1)
            going = open_value[np.arange(len(active)), best] > -np.inf
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            step = graph[cand[active, best]]
            fresh = (step >= 0) & ~seen[active[:, None], np.maximum(step, 0)]
            seen[np.repeat(active, fresh.sum(1)), step[fresh]] = True
            new = np.where(fresh, np.einsum("rkd,rd->rk", x[np.maximum(step, 0)], x[q[active]]), -np.inf)
            all_value = np.concatenate([value[active], new], 1)
            top = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
            value[active] = np.take_along_axis(all_value, top, 1)
            cand[active] = np.take_along_axis(np.concatenate([cand[active], np.where(fresh, step, -1)], 1), top, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(step.shape, bool)], 1), top, 1)
        # Range expansion from the query itself and from what the search has found.
        rows, cols = np.nonzero(value >= threshold - margin)
        front_q, front = np.concatenate([np.arange(len(q)), rows]), np.concatenate([q, cand[rows, cols]])
        reached = np.zeros((len(q), n), bool)
        reached[front_q, front] = True
        front_q, front = np.nonzero(reached)
        while len(front):
            step = graph[front]
            ok = step >= 0
            pairs = np.unique(np.repeat(front_q, ok.sum(1)) * n + step[ok])
            front_q, front = pairs // n, pairs % n
            fresh = ~reached[front_q, front]
            front_q, front = front_q[fresh], front[fresh]
            near = np.concatenate([np.einsum("rd,rd->r", x[q[front_q[i : i + 65536]]], x[front[i : i + 65536]]) for i in range(0, len(front), 65536)] or [np.zeros(0)])
            near = near >= threshold - margin
            front_q, front = front_q[near], front[near]
            reached[front_q, front] = True
        front_q, front = np.nonzero(reached)
        near = np.concatenate([np.einsum("rd,rd->r", x[q[front_q[i : i + 65536]]], x[front[i : i + 65536]]) for i in range(0, len(front), 65536)] or [np.zeros(0)])
        keep = (near >= threshold) & (q[front_q] != front)
        queries.append(q[front_q[keep]])
        founds.append(front[keep])
    return (np.concatenate(queries), np.concatenate(founds)) if queries else (np.zeros(0, np.int64),) * 2


def _valid(vector: Column, dimension: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimension) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def nodes_of(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, v) -> one row per distinct vector of a label: node (the least
    vec_id), label, v, copies."""
    size = F.size("v")
    commonest = rows.where("v IS NOT NULL AND size(v) > 0").groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(_valid(F.col("v"), commonest.n if commonest else 0))
    return kept.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def assign(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(cell, node, v): each node in the cells it is built and searched in."""
    sizes = stored(nodes.groupBy("label").agg(F.count("*").alias("n")), "embedding-labels")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.floor(F.col("n") * (min(OVERLAP / shard_rows, MAX_CENTROIDS / max(1, total)))).cast("int")
    large = sizes.withColumn("k", share).where("k > 1")
    # The rate keeps what is ranked bounded; ranking by hash makes the sample repeatable.
    part = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    sample = nodes.join(F.broadcast(large), "label").where(part * F.col("n") < SAMPLE_ROWS)  # at most MAX_CENTROIDS labels

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.array(table.sort_values("node")["v"].tolist(), float))
        found = centroids(x, min(len(x), int(table["k"].iloc[0])))
        return pd.DataFrame({"label": table["label"].iloc[0], "centre": found.tolist()})

    fitted = sample.select("label", "node", "v", "k").groupBy("label").applyInPandas(fit, "label string, centre array<double>")
    by_label: dict[str, list] = {}
    for row in fitted.collect():  # at most MAX_CENTROIDS
        by_label.setdefault(row.label, []).append(row.centre)
    sent = nodes.sparkSession.sparkContext.broadcast({label: np.array(c) for label, c in by_label.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shards: list[list[int]] = [[0]] * len(labels)
            groups: dict[str, list[int]] = {}
            for i, label in enumerate(labels):
                groups.setdefault(label, []).append(i)
            for label, rows in groups.items():
                centres = sent.value.get(label)
                if centres is not None:
                    m = min(OVERLAP, len(centres))
                    near = _unit(np.array([vectors[i] for i in rows], float)) @ centres.T
                    for i, top in zip(rows, np.argpartition(-near, m - 1, axis=1)[:, :m].tolist()):
                        shards[i] = top
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shards, pa.list_(pa.int32()))], ["label", "node", "shards"])

    dealt = nodes.select("label", "v", "node").mapInArrow(deal, "label string, node long, shards array<int>")
    dealt = stored(dealt.select("label", "node", F.explode("shards").alias("shard")), "embedding-shards")
    blocks = dealt.groupBy("label", "shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, mine).alias("lo"), F.greatest(j, mine).alias("hi")))
    cells = dealt.join(blocks, ["label", "shard"]).select("label", "node", "shard", F.explode(pairs).alias("p"))
    cells = cells.select("node", F.xxhash64("label", "shard", "p.lo", "p.hi").alias("cell"))
    return stored(cells.join(nodes.select("node", "v"), "node"), "embedding-cells")


def linked_pairs(nodes: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b), a < b: distinct pairs of nodes found with cosine >= threshold."""
    cells = assign(nodes, shard_rows)

    def build(table: pd.DataFrame) -> pd.DataFrame:
        ids = table["node"].to_numpy()
        graph = build_graph(_unit(np.array(table["v"].tolist(), float)))
        return pd.DataFrame({"node": ids, "next": [ids[row[row >= 0]].tolist() for row in graph]})

    lists = cells.groupBy("cell").applyInPandas(build, "node long, next array<long>")
    union = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "embedding-graph")

    def find(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("node")
        ids = table["node"].to_numpy()
        lists = [np.asarray(row, np.int64) for row in table["next"]]
        flat = np.concatenate(lists)
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        local = np.where(ids[at] == flat, at, -1)  # a neighbour that is not in this cell is passed over
        graph = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        ends = np.cumsum([len(row) for row in lists])
        for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
            graph[i, : b - a] = local[a:b]
        x = _unit(np.array(table["v"].tolist(), float))
        q, found = search(x, graph, threshold)
        return pd.DataFrame({"a": np.minimum(ids[q], ids[found]), "b": np.maximum(ids[q], ids[found])}).drop_duplicates()

    found = cells.join(union, "node").groupBy("cell").applyInPandas(find, "a long, b long")
    return stored(found.distinct(), "embedding-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (least vec_id reachable), kept (vec_id = component_id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    nodes = stored(nodes_of(rows), "embedding-nodes")
    pairs = linked_pairs(nodes, threshold, shard_rows)
    both = pairs.union(pairs.select("b", "a"))
    sizes = nodes.select("node", "copies")
    beyond = both.join(sizes, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("copies").alias("beyond"))
    components = connected_components(pairs)
    summed = nodes.join(beyond, F.col("node") == F.col("a"), "left").join(components, F.col("node") == F.col("vertex"), "left")
    summed = summed.select("label", "v", (F.coalesce("beyond", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    # Rows that are no node (not valid) find no partner here.
    found = rows.join(summed, ["label", "v"], "left")
    alone = F.col("vec_id").isNull() | F.col("component_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Recall of ``links`` (a, b over distinct vectors, a < b) for the nodes whose id is divisible
    by 20, against all rows of their labels, in blocks."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    nodes = stored(nodes_of(rows), "audit-nodes")
    count = max(1, nodes.count() // 4096)
    queries = nodes.where("node % 20 = 0").select("label", F.col("node").alias("q"), F.col("v").alias("w"), F.pmod(F.xxhash64("node"), F.lit(count)).alias("qb"))
    queries = queries.groupBy("label", "qb").agg(F.collect_list(F.struct("q", "w")).alias("queries"))
    rows = nodes.select("label", "node", "v", F.pmod(F.xxhash64("node"), F.lit(count)).alias("rb")).groupBy("label", "rb").agg(F.collect_list(F.struct("node", "v")).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, rows in zip(batch.column(0), batch.column(1)):
                q, r = queries.as_py(), rows.as_py()
                near = _unit(np.array([x["w"] for x in q], float)) @ _unit(np.array([x["v"] for x in r], float)).T
                ids, others = np.array([x["q"] for x in q]), np.array([x["node"] for x in r])
                i, j = np.nonzero((near >= threshold) & (ids[:, None] != others[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], others[j])), pa.array(np.maximum(ids[i], others[j]))], ["a", "b"])

    true = stored(queries.join(rows, "label").select("queries", "rows").mapInArrow(compare, "a long, b long").distinct(), "audit-pairs")
    total = true.count()
    return true.join(links, ["a", "b"], "left_semi").count() / total if total else 1.0
