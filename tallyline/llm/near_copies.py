"""Near copies by SimHash over word shingles: links every two texts whose sets of 5-word shingles
have a Jaccard similarity of 0.8 or more, and names the components.

First comes the SimHash search of ``simhash``: fingerprints of the shingle sets, embedded and met
in its grids, at most 4 bits apart; an exact check on the shingles follows. A similarity of 0.8
leaves fingerprints about ten bits apart, which no grid of 64 bits can search, so the links that
fingerprints miss are then sought exactly, between what SimHash left in different components.

There no pair is lost: two sets of that similarity share at least 4/5 of the larger one, so under any
common order of all shingles their first n - ceil(4n/5) + 1 members have one in common. These
prefixes are the cells of the search. Of a pair that meets in one, sizes and histograms of the
hashes are compared first: the sets differ in at least as many members as the histograms, and at
that similarity in at most a ninth of both sizes. What is left is compared on all shingles of
both texts. The order puts shingles last that a
sample of the rows holds often, so that a common line is hardly ever a cell. The sample only
changes the work, not the result.

Only connectivity is asked for. Texts with equal sets count once. Every text of a cell is first
compared with the least of the cell, unless SimHash linked them; where a cell then still holds several components, the texts
outside its largest one are compared with those of other components.

Defined cases: the words of a text under five words are one shingle; NULL and wordless texts have
the empty set and equal each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from tallyline.llm import simhash
from tallyline.llm.common import discard, stored
from tallyline.llm.components import connected_components

WORDS = 5
SAMPLE, COMMON, COMMON_SHINGLES = 4, 2, 200_000
BUCKETS = 128


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in ascending order."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = (ends[WORDS - 1 :] if len(tokens) >= WORDS else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, last)], np.uint64).view(np.int64))


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the rows holds often, ascending, and how many rows hold each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], ["s"])

    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "s long")
    counts = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = sorted((r.s, r.n) for r in counts.orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).collect())
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _marked(rows: DataFrame) -> DataFrame:
    """(row, doc_id, sign of the shingle set, n shingles, their SimHash, histogram of their hashes,
    prefix)."""
    common, often = _common(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, sizes, marks, bars, prefixes = [], [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                rank = np.zeros(len(s), np.int64)
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, often[at], 0)
                first = np.lexsort((s, rank))[: len(s) - (4 * len(s) + 4) // 5 + 1]
                signs.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                sizes.append(len(s))
                marks.append(simhash.fingerprint_of_set(s))
                bars.append(np.minimum(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                prefixes.append(s[first])
            columns = [pa.array(signs, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(bars, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "sign", "n", "fp", "bars", "prefix"])

    return rows.select("row", "doc_id", "text").mapInArrow(each, "row long, doc_id long, sign string, n long, fp long, bars binary, prefix array<long>")


@F.pandas_udf(BooleanType())
def _near(x: pd.Series, y: pd.Series, both: pd.Series) -> pd.Series:
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for s in (x, y))
    return pd.Series(9 * np.abs(a - b).sum(1, dtype=np.int64) <= both.to_numpy())


@F.pandas_udf(BooleanType())
def _alike(x: pd.Series, y: pd.Series) -> pd.Series:
    found = []
    for a, b in zip(x, y):
        a, b = shingles(a), shingles(b)
        both = len(np.intersect1d(a, b, assume_unique=True))
        found.append(5 * both >= 4 * (len(a) + len(b) - both))
    return pd.Series(found, dtype=bool)


def _links(pairs: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb), whose sizes allow it, that are alike. Histograms are looked
    up for pairs that met, texts for those whose histograms allow it."""
    fits = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    pairs = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both")).distinct()
    bars = lambda name, bar: marked.select(F.col("row").alias(name), F.col("bars").alias(bar))
    pairs = pairs.join(bars("b", "bb"), "b").join(bars("a", "ba"), "a")
    pairs = stored(pairs.where(_near("ba", "bb", "both")).select("a", "b"), "near-pairs")
    met = pairs.join(rows.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    met = met.join(rows.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
    return stored(met.where(_alike("x", "y")).select("a", "b"), "near-links")


def _simhash_links(texts: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) among ``texts`` (id, n, fp) whose fingerprints are at most 4 bits apart."""

    def checked(pairs: DataFrame) -> DataFrame:
        for name in "ab":
            pairs = pairs.join(texts.select(F.col("id").alias(name), F.col("n").alias(f"n{name}")), name)
        return _links(pairs, marked, rows)

    cells = simhash.shared_cells(texts)
    near = checked(simhash.head_pairs(cells))
    more = checked(simhash.mixed_pairs(cells, connected_components(near)))
    discard(cells)
    return near.union(more)


def components(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, text), row distinct -> (row, doc_id, component)."""
    marked = stored(_marked(rows), "near-marked")
    firsts = stored(marked.groupBy("sign").agg(F.min("row").alias("id")), "near-firsts")
    texts = marked.join(firsts.select(F.col("id").alias("row")), "row", "left_semi").withColumnRenamed("row", "id")
    by_marks = _simhash_links(texts, marked, rows)
    linked = stored(connected_components(by_marks), "near-linked")

    cells = texts.join(linked.withColumnRenamed("vertex", "id"), "id", "left")
    cells = cells.select("id", "n", F.coalesce("component", "id").alias("component"), F.explode("prefix").alias("cell"))
    heads = cells.groupBy("cell").agg(F.min(F.struct("id", "n", "component")).alias("head"), F.count("*").alias("held")).where("held > 1").drop("held")
    cells = stored(cells.join(heads, "cell").select("cell", "id", "n", "component", "head"), "near-cells")

    first = cells.where("component <> head.component").select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("head.id").alias("b"), F.col("head.n").alias("nb"))
    near = by_marks.union(_links(first, marked, rows))
    first = stored(connected_components(near), "near-first")
    here = cells.drop("component").join(first.withColumnRenamed("vertex", "id"), "id", "left").select("cell", "id", "n", F.coalesce("component", "id").alias("component"))
    here = stored(here, "near-labelled")
    sizes = stored(here.groupBy("cell", "component").agg(F.count("*").alias("held")), "near-sizes")
    largest = sizes.groupBy("cell").agg(F.max(F.struct("held", "component"))["component"].alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = here.join(largest.drop("kinds"), "cell")
    others = mixed.where("component <> largest").select("cell", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("other"))
    met = others.join(mixed.select("cell", F.col("id").alias("b"), F.col("n").alias("nb"), "component"), "cell")
    more = _links(met.where(F.col("other") != F.col("component")).select("a", "na", "b", "nb"), marked, rows)
    found = stored(connected_components(near.union(more)), "near-components")

    named = firsts.join(found.withColumnRenamed("vertex", "id"), "id", "left").select("sign", F.coalesce("component", "id").alias("component"))
    return marked.join(named, "sign").select("row", "doc_id", "component")
