"""Sums over every subtree of a forest by parallel tree contraction.

Two steps alternate until nothing is left. *Compress*: in a chain of nodes with one child each,
every node learns the bottom of its chain and the sum of the weights down to it, by pointer
doubling; the chain leaves the tree and its bottom hangs, with that sum as its carry, on what
stood above the chain. *Rake*: the leaves leave the tree and their weights (with their carries)
are added to their parents. After a compress every inner node has two children, so each rake
removes more than half of the nodes: the rounds grow with the logarithm of the tree, whatever
its depth. At last the rounds are undone from the last to the first: a raked leaf's sum is what
it weighed when it left, a chain node's is that of its chain's bottom plus the sum down to it.

All steps are joins on node keys that are unique on both sides, and sums combined before the
shuffle, so a node with any number of children is safe. Each round is written to the shared
folder; a lost executor replays a step, not the rounds before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import discard, stored


def subtree_sums(tree: DataFrame, weights: Sequence[str], max_rounds: int = 64) -> DataFrame:
    """``tree`` (node, parent, weights...) -> (node, weights...) summed over the node's subtree.

    ``node`` is unique and not NULL, of any type that can be compared; a NULL parent marks a
    root. Weights are longs. An empty tree gives an empty result; a parent that is not a node,
    or a cycle, is refused.
    """
    if not {"node", "parent", *weights} <= set(tree.columns):
        raise ValueError(f"a tree has the columns node, parent, {', '.join(weights)}")
    carries = [f"carry_{w}" for w in weights]
    active = stored(tree.select("node", "parent", *weights, *[F.lit(0).cast("long").alias(c) for c in carries]), "tree")
    raked: list[DataFrame] = []
    chains: list[DataFrame | None] = []
    size = active.count()
    while size:
        if len(raked) == max_rounds:
            raise ValueError(f"the tree is not contracted in {max_rounds} rounds")
        compressed, chain = _compress(active, weights, size)
        leaves, rest = _rake(compressed, weights)
        chains.append(chain)
        raked.append(leaves)
        if chain is not None:
            discard(compressed)
        discard(active)
        active, before, size = rest, size, rest.count()
        if size >= before:
            raise ValueError("a parent is not a node of the tree, or the tree has a cycle")
    discard(active)
    totals = tree.select("node", *weights).where("false")
    for leaves, chain in zip(reversed(raked), reversed(chains)):
        totals = totals.unionByName(leaves)
        if chain is not None:
            totals = stored(totals, "tree-sums")
            below = totals.select(F.col("node").alias("bottom"), *[F.col(w).alias(f"below_{w}") for w in weights])
            summed = chain.join(below, "bottom").select("node", *[(F.col(w) + F.col(f"below_{w}")).alias(w) for w in weights])
            totals = totals.unionByName(summed)
    return totals


def _compress(active: DataFrame, weights: Sequence[str], size: int) -> tuple[DataFrame, DataFrame | None]:
    """The tree without its chains, and (node, bottom, weights...) of every chain node: the sum
    from the node down to its bottom, without the bottom itself."""
    carries = [f"carry_{w}" for w in weights]
    only = active.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n"), F.max("node").alias("child"))
    only = only.where("n = 1").select(F.col("parent").alias("node"), "child")
    into = active.select(F.col("node").alias("child"), *[F.col(c).alias(f"into_{c}") for c in carries])
    links = active.join(only, "node").join(into, "child")
    links = stored(links.select("node", "parent", *carries, F.col("child").alias("bottom"), *[(F.col(w) + F.col(f"into_carry_{w}")).alias(w) for w in weights]), "tree-links")
    if links.isEmpty():
        discard(links)
        return active, None
    members = links.select("node")
    # A chain's top is the one that is no chain node's child.
    tops = links.select("node", "parent", *carries).join(links.select(F.col("bottom").alias("node")), "node", "left_anti")
    chain = links.select("node", "bottom", *weights)
    for n in range(size.bit_length() + 1):
        hop = chain.select(F.col("node").alias("bottom"), F.col("bottom").alias("further"), *[F.col(w).alias(f"hop_{w}") for w in weights])
        if chain.join(hop.select("bottom"), "bottom", "left_semi").isEmpty():
            break
        if n == size.bit_length():
            raise ValueError("the tree has a cycle")
        moved = chain.join(hop, "bottom", "left")
        longer = [(F.col(w) + F.coalesce(f"hop_{w}", F.lit(0))).alias(w) for w in weights]
        chain = stored(moved.select("node", F.coalesce("further", "bottom").alias("bottom"), *longer), "tree-chains")
    hung = tops.join(chain, "node").select(
        F.col("bottom").alias("node"), F.col("parent").alias("above"), *[(F.col(w) + F.col(f"carry_{w}")).alias(f"above_{w}") for w in weights]
    )
    rest = active.join(members, "node", "left_anti").join(hung.withColumn("hangs", F.lit(True)), "node", "left")
    moved_carries = [F.when(F.col("hangs"), F.col(f"above_{w}")).otherwise(F.col(f"carry_{w}")).alias(f"carry_{w}") for w in weights]
    rest = rest.select("node", F.when(F.col("hangs"), F.col("above")).otherwise(F.col("parent")).alias("parent"), *weights, *moved_carries)
    return stored(rest, "tree"), chain


def _rake(tree: DataFrame, weights: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves with their sums, the tree without them)."""
    carries = [f"carry_{w}" for w in weights]
    inner = tree.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = stored(tree.join(inner, "node", "left_anti"), "tree-leaves")
    given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(w) + F.col(f"carry_{w}")).alias(f"given_{w}") for w in weights])
    grown = [(F.col(w) + F.coalesce(f"given_{w}", F.lit(0))).alias(w) for w in weights]
    rest = tree.join(leaves.select("node"), "node", "left_anti").join(given, "node", "left").select("node", "parent", *grown, *carries)
    return leaves.select("node", *weights), stored(rest, "tree")
