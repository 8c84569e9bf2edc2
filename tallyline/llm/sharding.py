"""Shards of near-equal bytes by best-fit-decreasing packing of indivisible groups.

Equal texts form a group and stay together. Packing works on a list of bounded length: a group
of at least 1/256 of a shard's even share is an item of its own (there are at most 256 per
shard), the smaller ones are gathered by hash into 4096 parcels per 16 shards before packing. The
items, largest first, each enter the bin with the least remaining capacity that still holds them,
found in a balanced tree; the capacity is the smallest for which all items fit the given number of
shards.

A group larger than an even share fits no bin of that capacity. It alone is cut, by the number of
its rows, into as few parts of equal rows as fit; every other group stays whole. Numbers are counted
within blocks of rows and carried over the blocks, so they have no gaps whatever the ids are.

Scale: the texts are hashed in place; one narrow aggregation (digest, size; combined before the
shuffle) and one numbering pass over (shard, bucket) of narrow rows are shuffled. Only the
bounded item list reaches the driver, and only the bounded plan is broadcast.

Defined cases: a NULL text has size 1 and forms one group apart from the empty text; repeated
rows are rows like others; columns other than id and text are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tallyline.llm.common import id_text, stored

PARCELS = 4096
BLOCK_BITS = 17  # rows are numbered in blocks of at most 2 to this power
MAX_SHARDS = 4096


@dataclass
class _Node:
    key: tuple[int, int]  # (remaining capacity, bin)
    rank: int
    left: "_Node | None" = None
    right: "_Node | None" = None


class BinTree:
    """Open bins ordered by remaining capacity, in a treap with fixed pseudo-random ranks."""

    def __init__(self) -> None:
        self._root: _Node | None = None
        self._state = 1

    def add(self, remaining: int, bin_id: int) -> None:
        self._state = self._state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._cut(self._root, (remaining, bin_id))
        self._root = self._join(self._join(low, _Node((remaining, bin_id), self._state)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        low, high = self._cut(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        first = high
        while first.left is not None:
            first = first.left
        _, rest = self._cut(high, (first.key[0], first.key[1] + 1))
        self._root = self._join(low, rest)
        return first.key

    def _cut(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """The nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._cut(node.right, key)
            return node, high
        low, node.left = self._cut(node.left, key)
        return low, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b


def pack(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """Best-fit-decreasing: a bin for each size (in the given order), or None if ``bins`` do
    not suffice. A bin is opened only when no open one holds the item."""
    sizes = list(sizes)
    tree, opened, placed = BinTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > capacity:
            return None
        found = tree.take(sizes[i])
        if found is None:
            if opened == bins:
                return None
            found, opened = (capacity, opened), opened + 1
        tree.add(found[0] - sizes[i], found[1])
        placed[i] = found[1]
    return placed


def pack_evenly(sizes: Iterable[int], bins: int) -> list[int]:
    """The packing into ``bins`` bins of the smallest capacity that a search finds."""
    sizes = list(sizes)
    low, high = max([-(-sum(sizes) // bins), *sizes], default=0), sum(sizes)
    best = pack(sizes, high, bins) or []
    while low < high:
        middle = (low + high) // 2
        placed = pack(sizes, middle, bins)
        if placed is None:
            low = middle + 1
        else:
            best, high = placed, middle
    return best


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard (0 to shards - 1), and
    slot, which counts the rows of a shard from 0 without gaps."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be 1 to {MAX_SHARDS}")
    rows = id_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"),
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    rows = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    share = max(1, -(-total // shards))
    parcels = PARCELS * max(1, -(-shards // 16))
    least = max(1, share * 16 // parcels)
    parcel = F.pmod(F.xxhash64("digest"), F.lit(parcels)).cast("int")

    # Groups of at least `least` bytes: no more than shards * parcels / 16. Parcels: no more than `parcels`.
    big = groups.where(F.col("bytes") >= least)
    items = [(r.digest, r.bytes, r.n, min(r.n, -(-r.bytes // share))) for r in big.collect()]
    small = [(r.parcel, r.bytes) for r in groups.where(F.col("bytes") < least).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes")).collect()]
    keys: list[tuple[str, int]] = []
    sizes: list[int] = []
    for digest, size, n, parts in sorted(items):
        keys += [(digest, part) for part in range(parts)]
        # Rows of a group have one size; part p gets the rows whose number * parts // n is p.
        sizes += [size // n * (-(-(part + 1) * n // parts) - -(-part * n // parts)) for part in range(parts)]
    for number, size in sorted(small):
        keys.append((f"#{number}", 0))
        sizes.append(size)
    placed = pack_evenly(sizes, shards)
    plan: dict[str, list[int]] = {}
    for (key, _), bin_id in zip(keys, placed):
        plan.setdefault(key, []).append(bin_id)
    spark = docs.sparkSession
    counts = {digest: n for digest, _, n, _ in items}
    big_plan = spark.createDataFrame([(k, v, counts[k]) for k, v in plan.items() if k[:1] != "#"], "digest string, big_bins array<int>, n long")
    small_plan = spark.createDataFrame([(int(k[1:]), v[0]) for k, v in plan.items() if k[:1] == "#"], "parcel int, bin int")

    planned = rows.join(F.broadcast(big_plan), "digest", "left").withColumn("parcel", parcel).join(F.broadcast(small_plan), "parcel", "left")
    shown = ["row", "block", "doc_id", "size", "text_crc32"]
    whole = planned.where("big_bins IS NULL OR size(big_bins) = 1").select(*shown, F.coalesce(F.element_at("big_bins", 1), "bin").alias("shard"))
    cut = numbered(planned.where("size(big_bins) > 1"), "digest", "number")
    part = F.expr("CAST(number * size(big_bins) div n AS INT)")
    cut = cut.select(*shown, F.element_at("big_bins", part + 1).alias("shard"))
    dealt = stored(whole.unionByName(cut), "shard-dealt")
    return numbered(dealt, "shard", "slot").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (row, block, ...) with a number from 0 without gaps within each ``key``: counted in
    blocks of bounded size, and on from the blocks before."""
    counts = rows.groupBy(key, "block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = counts.select(key, "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "block").orderBy("row")
    within = rows.withColumn("__within", F.row_number().over(inside) - 1)
    return within.join(starts, [key, "block"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__start", "__within")
