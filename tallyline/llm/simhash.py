"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the number of ones in each of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so
it is a lower bound to search by. The embedding is kept packed, each count in unary, so that
Manhattan distance is one XOR and one bit count.

Grid range join: the 32 coordinates are cut into 8 runs. Two vectors within distance 4 differ in
at most 4 runs, so they agree in at least 4: they share a cell of one of the 70 grids that keep
4 runs each. Pairs that meet in a cell are checked by the lower bound, then exactly.

Only connectivity is asked for, so not all pairs of a cell are made. First every fingerprint of a
cell is compared with the least and the greatest of the cell (two joins with per-cell minima, in
proportion to the rows). After these links are merged, a cell matters only if it still holds
several components; there the fingerprints outside its largest component are joined with the
whole cell, with "different components and within 4 bits" in the join condition. So a cell with
very many near copies costs its rows, not its pairs, and no link between components is lost.

Plans size the rows of all cells as if they were the points, 70 times too few, and would send them
whole to every executor from the driver. So joins by cell are merge joins, whatever the estimate.

Rows are distinct fingerprints throughout; documents join at the end. All steps are joins,
minima and counts that combine before the shuffle.

Defined cases: a NULL or wordless text has fingerprint zero and links like any other. Repeated
rows share a fingerprint. A NULL id takes part in no component minimum but its row is returned.
An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import id_text, stored
from tallyline.llm.components import connected_components

DISTANCE = 4
LOW_BITS = 0x5555555555555555
# Two-bit segments per run; 4 of the 8 runs stay equal when at most 4 differ.
RUNS = (4,) * 8
KEPT_RUNS = 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text over word shingles, as a signed 64-bit number."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        pairs = zip(starts[at : min(at + (1 << 14), n)].tolist(), last[at : at + (1 << 14)].tolist())
        ones += _ones(np.array([digest(line[a:b], 42) for a, b in pairs], np.uint64))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += _ones(hashes[at : at + (1 << 14)])
    return _majority(ones, len(hashes))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(each, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Ones per two-bit segment, each count in unary: 0 -> 00, 1 -> 01, 2 -> 11."""
    low, half = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(half).bitwiseAND(low)
    two = fp.bitwiseAND(half).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def grids() -> list[int]:
    """Masks over the packed embedding, one for each choice of kept runs."""
    masks, at = [], 0
    for n in RUNS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return [_signed(sum(kept)) for kept in combinations(masks, KEPT_RUNS)]


def _near(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    bound = F.bit_count(embedding(x).bitwiseXOR(embedding(y))) <= DISTANCE
    return bound & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)


def _cells(points: DataFrame) -> DataFrame:
    """A row for each point and grid, with the cell as one hashed key."""
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("v").bitwiseAND(F.lit(m))) for n, m in enumerate(grids())])
    return points.withColumn("v", embedding(F.col("fp"))).select(*points.columns, F.explode(keys).alias("cell"))


def _by_cell(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` and ``b`` joined by cell, never through a broadcast."""
    return a.hint("merge").join(b.hint("merge"), "cell")


def link_components(points: DataFrame) -> DataFrame:
    """``points`` (id, fp), both distinct -> (id, component): the least id reachable by links of
    at most 4 differing bits."""
    dealt = _cells(points.select("fp"))
    heads = dealt.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    heads = heads.select("cell", F.explode(F.array("lo", "hi")).alias("head"))
    links = _by_cell(dealt, heads).where(_near("fp", "head") & (F.col("fp") != F.col("head"))).select("fp", "head").distinct()
    links = links.join(points.select("fp", F.col("id").alias("a")), "fp").join(points.select(F.col("fp").alias("head"), F.col("id").alias("b")), "head")
    first = stored(connected_components(links.select("a", "b")), "simhash-first")

    labelled = points.join(first.withColumnRenamed("vertex", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    labelled = stored(labelled, "simhash-labelled")
    dealt = _cells(labelled)
    mixed = dealt.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("cell")
    here = stored(_by_cell(dealt, mixed), "simhash-mixed")
    sizes = here.groupBy("cell", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cell").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    others = _by_cell(here, largest).where("component <> largest").select("cell", F.col("fp").alias("other_fp"), F.col("component").alias("other"))
    more = _by_cell(others, here).where((F.col("other") != F.col("component")) & _near("other_fp", "fp"))
    # Merge the components: their least members are vertices like others.
    second = stored(connected_components(more.select(F.col("other").alias("a"), F.col("component").alias("b")).distinct()), "simhash-second")
    merged = first.join(second.select(F.col("vertex").alias("component"), F.col("component").alias("upper")), "component", "left").select(F.col("vertex").alias("id"), F.coalesce("upper", "component").alias("component"))
    alone = second.join(first, "vertex", "left_anti").select(F.col("vertex").alias("id"), "component")
    found = stored(merged.union(alone), "simhash-components")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shared_cells(points: DataFrame) -> DataFrame:
    """(cell, id, fp, lo, hi): ``points`` (id, fp), id distinct, in each cell that holds several of
    them, with the least and greatest id there."""
    dealt = _cells(points.select("id", "fp"))
    held = dealt.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    return stored(_by_cell(dealt, held).select("cell", "id", "fp", "lo", "hi"), "simhash-cells")


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def head_pairs(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids at most 4 bits apart: each id of a cell with the cell's two heads."""
    heads = cells.where("id = lo OR id = hi").select("cell", F.col("id").alias("head"), F.col("fp").alias("head_fp"))
    return _by_cell(cells, heads).where((F.col("id") != F.col("head")) & _near("fp", "head_fp")).select(*_pairs("id", "head")).distinct()


def mixed_pairs(cells: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids at most 4 bits apart that share a cell but no component of ``named``
    (vertex, component): those outside a cell's largest component with the whole cell."""
    here = cells.join(named.withColumnRenamed("vertex", "id"), "id", "left").select("cell", "id", "fp", F.coalesce("component", "id").alias("component"))
    mixed = here.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("cell")
    here = stored(_by_cell(here, mixed), "simhash-mixed")
    sizes = here.groupBy("cell", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cell").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    others = _by_cell(here, largest).where("component <> largest").select("cell", F.col("id").alias("other_id"), F.col("fp").alias("other_fp"), F.col("component").alias("other"))
    met = _by_cell(others, here).where((F.col("other") != F.col("component")) & _near("other_fp", "fp"))
    return met.select(*_pairs("other_id", "id")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id reachable by links of at most 4 differing bits, itself included."""
    marked = stored(fingerprints(docs, words, id_col, text_col), "simhash-docs")
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-points")
    components = link_components(points.where("id IS NOT NULL"))
    named = points.join(components, "id", "left").select("fp", "component")
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
