"""The trie of conversation prefixes, with totals of every subtree by tree contraction.

Conversations that share their first turns share the nodes of those turns, so a node's members
could be stored, or served from a cache, once. Each node gets its members, children and, summed
over its subtree, its leaves and the tokens that sharing saves.

1. Turns are numbered. Narrow rows (digest of role and text, word count) are sorted over all
   partitions by conversation and turn; a turn's number is its place in its partition plus what
   the partitions before hold of its conversation, so a conversation of any length is spread.
2. A node is a prefix of turns and is known by a SHA-256 digest of the chain of turn digests.
   Chains are folded in pieces of ``PIECE`` turns; the digests of whole pieces are themselves
   chained in pieces, so no fold is longer than ``PIECE`` whatever the length.
3. Nodes are the groups of equal digests. Nodes with the same smallest member and the same
   number of members are a chain without branches, known by value: they enter the contraction
   as one node and are told apart afterwards by the running word count of their path.
4. ``contraction.subtree_sums`` alternates rake and compress and expands the result.

The member lists of ends are hashed as one string per node, as the digest asks. It is built of
ordered parts of at most ``PART`` ids, and the parts stream through the hash one by one.

Defined cases: rows without conv_id are left out. A NULL turn comes first; turns with the same
number are ordered by the digest of role and text, and repeated rows are turns of their own.
NULL role or text is empty. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import discard, stored
from tallyline.llm.contraction import subtree_sums

PIECE = 128  # turns folded at once
PART = 4096  # ids in one part of an end list
WORDS = r"[^\x20\x09-\x0D]+"
SEQUENCE = "conv_id long, depth long, digest binary, words long, last boolean"
HIDDEN = 33  # bits of the row number inside a partition, as Spark documents them


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words, place): ``at`` counts the turns of a conversation from 0,
    ``place`` ascends with conv_id over all rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    narrow = stored(narrow, "trie-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("place")), "trie-places")
    discard(narrow)
    placed = placed.withColumn("part", F.shiftright("place", HIDDEN))
    parts = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    starts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("place") - F.col("first")).alias("at"), "digest", "words", "place")


def sequences(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) as they are: (conv_id, place, length) and (conv_id, depth, digest, words, last)."""
    convs = numbered.groupBy("conv_id").agg(F.min("place").alias("place"), F.count("*").alias("length"))
    lengths = convs.select("conv_id", "length")
    return convs, numbered.join(lengths, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "words", (F.col("at") + 1 == F.col("length")).alias("last"))


def borrowed_sequences(numbered: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same with borrowed beginnings: conversation c takes the first h = crc32(c) mod ``most``
    turns of conversation c - c % ``every`` (all if there are fewer; the remainder has the sign of
    c) in place of its own first h."""
    own = numbered.withColumn("h", _borrowed(most))
    convs = own.groupBy("conv_id", "h").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    lenders = own.where((F.col("conv_id") % every == 0) & (F.col("at") < most - 1)).select(F.col("conv_id").alias("lender"), "at", "digest", "words")
    lent = lenders.groupBy("lender").agg(F.count("*").alias("lent"))
    convs = (
        convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % every)
        .join(lent, "lender", "left")
        .withColumn("k", F.least("h", F.coalesce("lent", F.lit(0))))
        .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = stored(convs.select("conv_id", "place", "lender", "h", "k", "length"), "trie-conversations")
    taken = convs.select("conv_id", "lender", "k", "length").join(lenders, "lender").where("at < k")
    # The one join by conversation alone: the adaptive join splits the rows of a very long one.
    kept = own.where("at >= h").join(convs.select("conv_id", "k", "length"), "conv_id")
    depth = F.col("at") - F.col("h") + F.col("k") + 1
    rebuilt = taken.select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "words", "length").unionByName(
        kept.select("conv_id", depth.alias("depth"), "digest", "words", "length")
    )
    return convs.select("conv_id", "place", "length"), rebuilt.select("conv_id", "depth", "digest", "words", (F.col("depth") == F.col("length")).alias("last"))


def _borrowed(most: int) -> Column:
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")


def prefix_ids(rows: DataFrame) -> DataFrame:
    """(seq, at, digest, w, ...) with ``at`` gapless from 0 -> the same with ``before`` and ``id``,
    the digests of the prefixes without and with the row, and ``total``, the sum of w up to it."""
    others = [c for c in rows.columns if c not in ("seq", "at", "digest", "w")]
    piece = F.col("at").cast("long") - F.col("at") % PIECE
    items = F.array_sort(F.collect_list(F.struct("at", "digest", "w", *others)))
    grouped = rows.groupBy("seq", (piece / PIECE).cast("long").alias("piece")).agg(items.alias("items"))
    step = "struct<p:binary,total:bigint,out:array<struct<p:binary,total:bigint>>>"
    start = F.expr(f"CAST(named_struct('p', X'', 'total', 0L, 'out', array()) AS {step})")

    def fold(state: Column, item: Column) -> Column:
        p = F.unhex(F.sha2(F.concat(state["p"], item["digest"]), 256))
        total = state["total"] + item["w"]
        return F.struct(p.alias("p"), total.alias("total"), F.concat(state["out"], F.array(F.struct(p.alias("p"), total.alias("total")))).alias("out")).cast(step)

    grouped = stored(grouped.withColumn("chain", F.aggregate("items", start, fold, lambda s: s["out"])), "trie-pieces")
    if not grouped.where("piece > 0").isEmpty():
        whole = grouped.where(F.size("items") == PIECE).select("seq", F.col("piece").alias("at"), F.element_at("chain", -1)["p"].alias("digest"), F.element_at("chain", -1)["total"].alias("w"))
        above = prefix_ids(whole).select("seq", F.col("at").alias("piece"), F.col("id").alias("through"), F.col("total").alias("sum"))
        grouped = grouped.join(above, ["seq", "piece"], "left")
        # What the pieces before give: the entry of the piece before this one.
        ahead = above.select("seq", (F.col("piece") + 1).alias("piece"), F.col("through").alias("base"), F.col("sum").alias("base_sum"))
        grouped = grouped.join(ahead, ["seq", "piece"], "left")
    else:
        grouped = grouped.withColumns({"through": F.element_at("chain", -1)["p"], "base": F.lit(None).cast("binary"), "base_sum": F.lit(0)})
    base = F.coalesce("base", F.lit(b""))
    exploded = grouped.select("seq", base.alias("base"), F.coalesce("base_sum", F.lit(0)).cast("long").alias("base_sum"), "through", "chain", F.posexplode("items").alias("i", "item"))
    inside = lambda i: F.unhex(F.sha2(F.concat("base", F.get("chain", i)["p"]), 256))
    return exploded.select(
        "seq",
        "item.at",
        "item.digest",
        "item.w",
        *[F.col("item")[c].alias(c) for c in others],
        F.when(F.col("i") == 0, F.col("base")).otherwise(inside(F.col("i") - 1)).alias("before"),
        F.when(F.col("i") == PIECE - 1, F.col("through")).otherwise(inside(F.col("i"))).alias("id"),
        (F.col("base_sum") + F.get("chain", F.col("i"))["total"]).alias("total"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, id, conv_id, place) -> (depth, id, ends_sha256): the ids of a node's ends in
    ascending order, comma-joined and hashed. A part holds at most PART of them."""
    part = F.shiftright("place", PART.bit_length() - 1).alias("part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("depth", "id", part).agg(joined.alias("ids"))
    ordered = parts.repartition("depth", "id").sortWithinPartitions("depth", "id", "part").select("depth", "id", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def given() -> pa.RecordBatch:
            depths, ids, texts = list(zip(*out)) if out else ([], [], [])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(depths, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["depth", "id", "ends_sha256"])

        for batch in batches:
            for depth, node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, node) != current:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield given()
        if current is not None:
            out.append((*current, state.hexdigest()))
        yield given()

    return ordered.mapInArrow(hashed, "depth long, id binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, depth, digest, words, last) rows; ``convs`` lists
    every conversation as (conv_id, place, length)."""
    convs = stored(convs.select("conv_id", "place", "length"), "trie-members")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    rows = turns.select(F.col("conv_id").alias("seq"), (F.col("depth") - 1).alias("at"), "digest", F.col("words").alias("w"), "last")
    paths = stored(prefix_ids(rows), "trie-paths")
    depth = (F.col("at") + 1).alias("depth")
    groups = paths.groupBy(depth, "id").agg(
        F.min("seq").alias("conv_id"), F.count("*").alias("n_convs"), F.min("before").alias("before"), F.min("w").alias("words"), F.min("total").alias("path_words")
    )
    groups = stored(groups, "trie-groups")
    at_root = groups.sparkSession.createDataFrame(
        [(0, bytearray(), root.conv_id, root.n_convs, 0, 0)] if root.n_convs else [], "depth long, id binary, conv_id long, n_convs long, words long, path_words long"
    )
    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("id")).agg(F.count("*").alias("n_children"))
    places = convs.select(F.col("conv_id").alias("seq"), "place")
    ending = paths.where("last").select(depth, "id", "seq").join(places, "seq").select("depth", "id", F.col("seq").alias("conv_id"), "place")
    ending = ending.unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("id"), "conv_id", "place"))
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("id").alias("before"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    # All first turns have the root above them, which is known; other parents are looked up.
    first = groups.where("depth = 1").withColumns({"parent_conv_id": F.lit(root.conv_id).cast("long"), "parent_n": F.lit(root.n_convs).cast("long")})
    deeper = groups.where("depth > 1").join(above, ["depth", "before"])
    nodes = first.unionByName(deeper).drop("before").unionByName(at_root, allowMissingColumns=True)
    nodes = nodes.join(children, ["depth", "id"], "left").join(end_digests(ending), ["depth", "id"], "left")
    nodes = stored(
        nodes.select(
            "conv_id", "depth", "parent_conv_id", "parent_n", "n_convs", "words", "path_words",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    discard(paths)
    discard(groups)

    run = F.struct(F.col("conv_id"), F.col("n_convs"))
    runs = nodes.groupBy("conv_id", "n_convs").agg(
        F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("up"),
        F.min(F.col("path_words") - F.col("words")).alias("words_above"),
        F.max("path_words").alias("words_through"),
        F.max((F.col("n_children") == 0).cast("long")).alias("n_leaves"),
    )
    parent = F.when(F.col("up.parent_conv_id").isNotNull(), F.struct(F.col("up.parent_conv_id").alias("conv_id"), F.col("up.parent_n").alias("n_convs")))
    saved = (F.col("n_convs") - 1) * (F.col("words_through") - F.col("words_above"))
    runs = stored(runs.select(run.alias("node"), parent.alias("parent"), "n_leaves", saved.alias("saved_tokens"), "words_above"), "trie-runs")
    sums = subtree_sums(runs.select("node", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    sums = sums.join(runs.select("node", "words_above"), "node").select("node.conv_id", "node.n_convs", "n_leaves", F.col("saved_tokens").alias("run_saved"), "words_above")
    # Nodes of one run have the same leaves; of its savings, a node lacks those of the nodes above it.
    skipped = (F.col("n_convs") - 1) * (F.col("path_words") - F.col("words") - F.col("words_above"))
    return nodes.join(sums, ["conv_id", "n_convs"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("run_saved") - skipped).alias("saved_tokens"), "ends_sha256"
    )


def conversation_trie(conversations: DataFrame, borrowed: bool = False) -> DataFrame:
    """One row per distinct prefix of turns: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. ``borrowed`` rebuilds the
    conversations with ``borrowed_sequences`` first."""
    numbered = stored(numbered_turns(conversations), "trie-numbered")
    return trie(*(borrowed_sequences if borrowed else sequences)(numbered))
