"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into runs of letters and digits. A document is contaminated by an
item if 13 consecutive words of the item appear in it with at most 2 of them substituted. Three
fixed masks each keep every third position of a 13-word span and ignore the others; two
substitutions spoil at most two of the three, so one mask always hashes equal words. Seeds of
the benchmark are joined with the seeds of every document position, and each meeting is checked
word by word over the span around it; the first mask that agrees reports it, once.

Items of 5 to 12 words are sought whole and exactly, with one solid mask of their length. Items
of fewer words are not sought. Items with the same words count as one, named by the least id.

Scale: each text is hashed to an array of word hashes once; positions, masks, the probe and the
check run in generated code in the scan's own stage, and only verified spans are shuffled, after
counting. The benchmark's seeds are broadcast when they are at most ``BROADCAST_ROWS``;
beyond that the join is shuffled, with the same result.

Defined cases: NULL texts have no words. NULL ids are kept as they are. Repeated rows of a
document add no windows, since windows are told apart by position. An empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import id_text

SPAN, MASKS, ALLOWED = 13, 3, 2
LEAST_WORDS = 5
BROADCAST_ROWS = 1_000_000
# Anything that is neither a letter nor a digit parts words.
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), NOT_WORD), "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _seed(hashes: str, at: str, span: int, mask: int, masks: int) -> Column:
    kept = [F.expr(f"{hashes}[{at} + {k}]") for k in range(mask, span, masks)]
    return F.xxhash64(F.lit(mask), *kept)


def _positions(rows: DataFrame, span: int) -> DataFrame:
    return rows.where(F.size("h") >= span).select("*", F.explode(F.sequence(F.lit(0), F.size("h") - span)).alias("at"))


def _seeds(rows: DataFrame, span: int, masks: int) -> DataFrame:
    """A row for each position and mask."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), _seed("h", "at", span, m, masks).alias("seed")) for m in range(masks)])).alias("s")
    return _positions(rows, span).select("*", each).select(*[c for c in (*rows.columns, "at")], "s.mask", "s.seed")


def _search(docs: DataFrame, items: DataFrame, span: int, masks: int, allowed: int) -> DataFrame:
    """Spans of ``docs`` (doc_id, h) that agree with spans of ``items`` (item_id, h) but for
    ``allowed`` words: (doc_id, item_id, at, matched)."""
    theirs = _seeds(items, span, masks).select("seed", "item_id", F.expr(f"slice(h, at + 1, {span})").alias("words"))
    # The same words at several places of an item are one span. A seed hashes its mask too, and the
    # words that the mask keeps are compared below, so one long is the whole key.
    theirs = theirs.distinct()
    mine = _seeds(docs, span, masks)
    if theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        theirs = F.broadcast(theirs)
    else:
        mine = mine.select("doc_id", "at", "mask", "seed", F.expr(f"slice(h, at + 1, {span})").alias("own"))
        mine = mine.withColumn("h", F.col("own")).withColumn("here", F.lit(0))
    if "here" not in mine.columns:
        mine = mine.withColumn("here", F.col("at"))
    met = mine.join(theirs, "seed")
    same = [F.expr(f"h[here + {k}] = words[{k}]") for k in range(span)]
    matched = reduce(lambda a, b: a + b, [s.cast("int") for s in same])
    agrees = [reduce(and_, same[m::masks]) for m in range(masks)]
    first = F.lit(masks)
    for m in reversed(range(masks)):
        first = F.when(agrees[m], m).otherwise(first)
    return met.select("doc_id", "item_id", "at", "mask", matched.alias("matched"), first.alias("first")).where((F.col("matched") >= span - allowed) & (F.col("first") == F.col("mask"))).select("doc_id", "item_id", "at", "matched")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Every contaminated span: doc_id, item_id, at (word position), matched, words."""
    docs = id_text(docs).select("doc_id", word_hashes(F.col("text")).alias("h"))
    items = id_text(benchmark, item_col).select(F.col("doc_id").alias("item_id"), word_hashes(F.col("text")).alias("h"))
    items = items.where(F.size("h") >= LEAST_WORDS).groupBy("h").agg(F.min("item_id").alias("item_id"))
    found = _search(docs, items.where(F.size("h") >= SPAN), SPAN, MASKS, ALLOWED).withColumn("words", F.lit(SPAN))
    short = items.where(F.size("h") < SPAN)
    lengths = sorted(r.n for r in short.select(F.size("h").alias("n")).distinct().collect())  # at most 8
    for n in lengths:
        found = found.union(_search(docs, short.where(F.size("h") == n), n, 1, 0).withColumn("words", F.lit(n)))
    return found


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """One row per document and item that share a span: doc_id, item_id, n_spans, first_word,
    end_word, best_matched."""
    spans = contaminated_spans(docs, benchmark, item_col)
    places = spans.groupBy("doc_id", "item_id", "at", "words").agg(F.max("matched").alias("matched"))
    return places.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_spans"),
        F.min("at").cast("long").alias("first_word"),
        F.max(F.col("at") + F.col("words")).cast("long").alias("end_word"),
        F.max("matched").cast("long").alias("best_matched"),
    )
