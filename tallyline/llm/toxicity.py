"""Toxicity by compression distance: does a window compress better with a dictionary of toxic
or of ordinary text?

Two zstandard dictionaries of equal length are trained on the text of labelled documents, each on
its own class: the runs of characters that occur in more documents of the class than chance
allows, of every language and inside words too. Runs are words that hold
``GRAM`` characters that pass a likelihood ratio test (no share of documents is asked for). Both dictionaries end with the same commonest ordinary words, and
the shorter one is filled up with more of them, so that offsets and hash places are alike. Every
text is cut into short overlapping windows (under 64 bytes, where zstandard writes literals as
they are, so lengths change by matches alone). A window that is shorter with the toxic dictionary
is cut again into small pieces, whose largest difference is its evidence. A logistic rule over the
evidence of a text, fitted on the labelled sample and weighted to the true share of labels, is the
calibrated score.

The sample is bounded: at most ``TRAIN_PER_CLASS`` documents per label, those with the least hash
of their id. Grams and runs of the sample are counted by Spark; only the chosen ones (at most
``GRAMS`` and ``OWN_RUNS`` per class) and the features of each sampled document reach the driver.
Scoring is one pass without a shuffle, over whole texts.

Defined cases: a NULL text is scored like an empty one, which has no evidence. Several labels of
one id count as toxic if any is; NULL labels and ids are left out. Repeated rows are scored each.
Without labels of both kinds, or when no gram of the toxic text passes the test, there is no
evidence: the model has no weights and every score is the share of toxic labels (0 if there are
none); who rejects documents should keep them then. Only id and text are read from the documents, only id and
toxic from the labels.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import id_text, stored

TRAIN_PER_CLASS = 2000
HELD_OUT_MODULUS = 5
COMMON_WORDS = 200
GRAM = 5
GRAMS = 4096
OWN_RUNS, OWN_BYTES = 4096, 4096  # of a class
RUN_CHARS = 24
AGAIN = 0.7
LEAST_EXCESS = 3.0  # share of documents of the class over that of the other
WINDOW, STEP = 63, 48
PIECE, PIECE_STEP = 26, 6
SUSPECT = 2
EVIDENCE = (3, 4, 5, 6, 7)
LEVEL = 6
FEATURES = ("largest", "second", *(f"at_{n}" for n in EVIDENCE), "total", "density", "length")
WORDS = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
WORD_BYTES = re.compile(rb"[^\x00-/:-@\[-`{-\x7f]+")


def crc_remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS


@dataclass(frozen=True)
class Model:
    toxic: str
    ordinary: str
    weights: tuple[float, ...]  # intercept and FEATURES; empty: the score is the share
    share: float


@lru_cache(maxsize=4)
def _compressors(toxic: str, ordinary: str):
    make = lambda text: zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False
    )
    return make(toxic).compress, make(ordinary).compress


def evidence(text: str | None, toxic: str, ordinary: str) -> tuple[float, ...]:
    """FEATURES of a whole text."""
    with_toxic, with_ordinary = _compressors(toxic, ordinary)
    line = b" " + b" ".join(WORD_BYTES.findall((text or "").lower().encode())) + b" "
    found = [0, 0]
    windows = range(0, max(1, len(line) - WINDOW + STEP), STEP)
    for at in windows:
        window = line[at : at + WINDOW]
        if len(with_ordinary(window)) - len(with_toxic(window)) >= SUSPECT:
            pieces = [window[i : i + PIECE] for i in range(0, max(1, len(window) - PIECE + PIECE_STEP), PIECE_STEP)]
            found.append(max(0, *(len(with_ordinary(p)) - len(with_toxic(p)) for p in pieces)))
    first, second = sorted(found)[: -3 : -1]
    many = [float(np.log1p(sum(x >= least for x in found))) for least in EVIDENCE]
    return float(min(first, 12)), float(min(second, 12)), *many, float(np.log1p(sum(found))), sum(found) / len(windows), float(np.log1p(len(windows)))


def features(text: Column, toxic: str, ordinary: str) -> Column:
    """FEATURES of a text column, as a struct."""

    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence(t, toxic, ordinary) for t in texts], columns=FEATURES, dtype=float)

    return F.pandas_udf(each, ", ".join(f"{n} double" for n in FEATURES))(text)


def grams_of(word: str) -> list[str]:
    """Stretches of ``GRAM`` characters of a word with a space on both sides."""
    word = f" {word} "
    return [word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))]


def runs_of(word: str, grams: frozenset[str]) -> list[str]:
    """A word that holds a gram of the set, with its spaces; of a long one the parts that do."""
    line = f" {word} "
    parts = [line[i : i + RUN_CHARS] for i in range(0, len(line), RUN_CHARS - GRAM + 1)]
    return [p for p in parts if any(p[i : i + GRAM] in grams for i in range(max(1, len(p) - GRAM + 1)))]


def _counted(sample: DataFrame, parts) -> DataFrame:
    """(part, t, o): toxic and ordinary documents of the sample that hold a part."""

    def each(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORDS.findall((text or "").lower()))
                for part in {part for word in words for part in parts(toxic, word)}:
                    found.setdefault(part, [0, 0])[toxic] += 1
                if len(found) > 200_000:
                    yield _batch(found)
                    found = {}
            yield _batch(found)

    dealt = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(each, "part string, t long, o long")
    return dealt.groupBy("part").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _batch(found: dict[str, list[int]]) -> pa.RecordBatch:
    ordinary, toxic = [v[0] for v in found.values()], [v[1] for v in found.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(toxic, pa.int64()), pa.array(ordinary, pa.int64())], ["part", "t", "o"])


def own_grams(sample: DataFrame, counts: dict[int, int]) -> dict[int, dict[str, float]]:
    """Grams of each class in more of its documents than chance allows among that many grams, with
    the likelihood ratio of each."""
    seen = stored(_counted(sample, lambda _, word: grams_of(word)), "toxicity-grams")
    least = 2 * np.log(max(2, seen.count()))
    both, kinds = F.col("t") + F.col("o"), float(counts[0] + counts[1])
    term = lambda n, mean: F.when(n > 0, n * F.log(n / mean)).otherwise(0.0)
    ratio = F.lit(0.0)
    for n, kind in ((F.col("t"), counts[1]), (F.col("o"), counts[0])):
        ratio = ratio + term(n, both * kind / kinds) + term(kind - n, (kinds - both) * kind / kinds)
    seen = seen.select("part", (2 * ratio).alias("ratio"), ((F.col("t") + 0.5) / (counts[1] + 1.0)).alias("ts"), ((F.col("o") + 0.5) / (counts[0] + 1.0)).alias("os"))
    chosen = {}
    for kind, side, other in ((1, "ts", "os"), (0, "os", "ts")):
        apart = seen.where((F.col("ratio") >= float(least)) & (F.col(side) >= LEAST_EXCESS * F.col(other)))
        chosen[kind] = {r.part: r.ratio for r in apart.orderBy(F.desc("ratio"), "part").limit(GRAMS).collect()}
    return chosen


def own_runs(sample: DataFrame, grams: dict[int, dict[str, float]]) -> dict[int, str]:
    """Text of each class that covers its grams: the run whose grams not yet covered weigh most
    comes next. Covered grams keep ``AGAIN`` of their weight, so a stem comes with several endings. The
    first run ends the text, where zstandard finds it at the shortest distance."""
    sets = {kind: frozenset(found) for kind, found in grams.items()}
    counted = stored(_counted(sample, lambda toxic, word: runs_of(word, sets[toxic])), "toxicity-runs")
    texts = {}
    for kind, n in ((1, "t"), (0, "o")):
        rows = counted.where(F.col(n) > 1).orderBy(F.desc(n), "part").limit(OWN_RUNS).collect()
        weigh = lambda part, left: sum(left.get(part[i : i + GRAM], 0.0) for i in range(max(1, len(part) - GRAM + 1)))
        left, taken, size = dict(grams[kind]), [], 0
        heap = [(-weigh(r.part, left), r.part) for r in rows]
        heapq.heapify(heap)
        while heap:
            bound, part = heapq.heappop(heap)
            gain = weigh(part, left)
            if gain <= 0 or size + len(part.encode()) >= OWN_BYTES:
                continue
            if gain < -bound:
                heapq.heappush(heap, (-gain, part))
                continue
            taken.append(part)
            size += len(part.encode())
            for i in range(max(1, len(part) - GRAM + 1)):
                if part[i : i + GRAM] in left:
                    left[part[i : i + GRAM]] *= AGAIN
        texts[kind] = "".join(reversed(taken))
    return texts


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0."""
    docs = id_text(docs)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_remainder(F.col("doc_id")) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model("", "", (), share)
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = marked.where("toxic = 1").orderBy(*order).limit(TRAIN_PER_CLASS).union(marked.where("toxic = 0").orderBy(*order).limit(TRAIN_PER_CLASS))
    sample = stored(docs.join(F.broadcast(picked), "doc_id"), "toxicity-sample")  # at most 2 * TRAIN_PER_CLASS ids
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model("", "", (), share)
    grams = own_grams(sample, counts)
    if not grams[1]:
        return Model("", "", (), share)
    own = own_runs(sample, grams)
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x00-/:-@\[-`{-\x7f]+"))).alias("word")
    seen = sample.where("toxic = 0").select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("o"))
    common = [r.word for r in seen.orderBy(F.desc("o"), "word").limit(10 * COMMON_WORDS).collect()]
    base, more = " ".join(common[:COMMON_WORDS]), " ".join(common[COMMON_WORDS:])
    length = max(len(x.encode()) for x in own.values())
    toxic, ordinary = (f" {_filled(own[kind], more or base, length)} {base} " for kind in (1, 0))
    rows = sample.select("doc_id", "toxic", features(F.col("text"), toxic, ordinary).alias("f")).select("doc_id", "toxic", "f.*").orderBy("doc_id", *FEATURES).collect()
    x = np.array([[1.0, *(r[n] for n in FEATURES)] for r in rows])
    y = np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, totals[1] / counts[1], totals[0] / counts[0])
    return Model(toxic, ordinary, tuple(_logistic(x, y, weight / weight.mean())), share)


def _filled(own: str, words: str, length: int) -> str:
    """``own`` after as much ordinary text as makes it ``length`` bytes long."""
    lacks = length - len(own.encode())
    text = (f"{words} " * (1 + lacks // (1 + len(words.encode())))).encode()[:lacks].decode(errors="ignore")
    return " " * (lacks - len(text.encode())) + text + own


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weighted logistic regression by Newton steps, the intercept not shrunk."""
    b = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) * len(y) / 100 + np.eye(x.shape[1]) * 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - keep @ b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(curve, slope)
        b += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return b.tolist()


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1."""
    if not model.weights:
        return F.lit(float(model.share))
    found = features(text, model.toxic, model.ordinary)
    line = F.lit(model.weights[0])
    for name, w in zip(FEATURES, model.weights[1:]):
        line = line + found[name] * w
    return 1 / (1 + F.exp(-line))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if >= 0.5)."""
    held_out = crc_remainder(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 0
    scored = id_text(docs).select("doc_id", held_out.alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
