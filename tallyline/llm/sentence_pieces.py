"""SentencePiece encoding and decoding through a relational lattice.

Text becomes the model's form (a leading mark, spaces as marks) and is cut into words where no
piece can go across: before a mark, and between letters and other characters (checked against
the vocabulary when it is loaded). For a word, every substring of bounded length is exploded
and joined with the piece table: the edges of the word's lattice. The model merges pairs rather
than maximising a sum, so the state of the fold at a position is the last piece, and an edge
extends a state only if the two pieces stand apart, that is, if merging their joined text leaves
both as they are. Exactly one path survives at each position, the library's own segmentation; a
Spark ``aggregate`` folds the edges of each word in order.

Words are counted over all texts, and the commonest ``LATTICE_WORDS`` go through the relational
lattice. Joining every occurrence of every word would shuffle several times the input, so the
finished table, bounded by that parameter, is sent to the tasks, which encode whole texts in one
pass; for a word outside the table they build the same lattice and fold it in place.

Defined cases: a NULL or empty text has no pieces. Characters outside the vocabulary become
their UTF-8 byte pieces. Decoding drops the leading mark's space; ids outside the vocabulary are
refused. A text that holds the mark character itself does not survive the round trip (the mark
reads as a space); ``round_trip`` says so. Repeated rows and empty tables are ordinary. Columns
other than id and text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.bpe import PrefixBpe
from tallyline.llm.common import id_text, stored

MARK = "▁"
LATTICE_WORDS = 1 << 16
LONGEST_WORD = 32  # of the lattice table, in characters
CACHED_WORDS = 100_000
FINE = rf"{MARK}*(?:[^\W\d_]+|(?:[^\w{MARK}]|[\d_])+)|{MARK}+"
COARSE = rf"{MARK}+[^{MARK}]*|[^{MARK}]+"


class Pieces:
    """A model file's vocabulary, its words, and its merging rule."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {texts[i]: i for i in plain}
        self.bytes = {int(texts[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        rank = {texts[i]: -model.get_score(i) for i in plain}
        self.bpe = PrefixBpe(self.ids, lambda a, b: rank.get(a + b))
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces with a mark inside are not supported")
        mixed = any(len({bool(re.match(r"[^\W\d_]", c)) for c in t.lstrip(MARK)}) > 1 for t in self.ids)
        self.words = re.compile(COARSE if mixed else FINE)
        self.raw: list[bytes | None] = [None] * size
        for text, i in self.ids.items():
            self.raw[i] = text.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def piece_ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def word_ids(self, word: str) -> bytes:
        """32-bit ids of a word, by folding its lattice here."""
        found = self._new.get(word)
        if found is None:
            found = self._old.get(word)
            if found is None:
                found = array("i", self.piece_ids(self.bpe.segment(word))).tobytes()
            if len(word) <= LONGEST_WORD:
                if len(self._new) >= CACHED_WORDS:
                    self._old, self._new = self._new, {}
                self._new[word] = found
        return found

    def split(self, text: str | None) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None, table: dict[str, bytes]) -> np.ndarray:
        known, other = table.get, self.word_ids
        return np.frombuffer(b"".join([known(w) or other(w) for w in self.split(text)]), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        parts = [self.raw[i] if 0 <= i < len(self.raw) else None for i in ids]
        if None in parts:
            raise ValueError("an id outside the vocabulary")
        raw = b"".join(parts)
        return raw.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def common_words(docs: DataFrame, model: str, limit: int = LATTICE_WORDS) -> DataFrame:
    """(word, n): the commonest words of all texts, at most ``limit``. Counts are cut at a step of
    a logarithmic scale, so nothing is sorted and words of like counts stay or go together."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        pieces, seen = load(model), Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(pieces.split(text.as_py()))
                if len(seen) > 4 * CACHED_WORDS:
                    yield given()
        yield given()

    words = docs.select("text").mapInArrow(counted, "word string, n long").where(F.length("word") <= LONGEST_WORD)
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "lattice-counts")
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.step, r.words) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)  # at most 16 * 64
    least, taken = 1 << 30, 0
    for number, size in sizes:
        taken += size
        if taken > limit:
            break
        least = number
    return words.where(step >= least)


def lattice_segments(words: DataFrame, model: str) -> DataFrame:
    """(word, ids): each word of ``words`` (distinct, not empty) encoded by joins and a fold."""
    spark = words.sparkSession
    pieces = load(model)
    table = spark.createDataFrame(list(pieces.ids.items()), "piece string, id int")  # the vocabulary: bounded by the model
    starts = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s")
    ends = F.explode(F.sequence(F.col("s") + 1, F.least(F.length("word"), F.col("s") + pieces.longest))).alias("e")
    spans = words.select("word").repartition("word").select("word", starts).select("word", "s", ends)
    spans = spans.select("word", "s", "e", F.expr("substring(word, s + 1, e - s)").alias("piece"))
    edges = spans.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR e = s + 1")
    edges = stored(edges.select("word", "s", "e", "piece", "id"), "lattice-edges")

    left = edges.select("word", F.col("e").alias("s"), F.col("piece").alias("before"))
    first = edges.where("s = 0").select(F.lit("").alias("before"), "piece")
    pairs = edges.join(left, ["word", "s"]).select("before", "piece").union(first).distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model).bpe
        for batch in batches:
            keep = [bpe.apart(a, b) if a else bpe.whole(b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    apart = stored(pairs.mapInArrow(verified, "before string, piece string"), "lattice-pairs")
    after = edges.join(left, ["word", "s"]).union(edges.where("s = 0").select("word", "s", "e", "piece", "id", F.lit("").alias("before")))
    allowed = after.join(apart, ["before", "piece"]).groupBy("word", "s", "e", "piece", "id").agg(F.collect_set("before").alias("before"))
    by_word = allowed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("s", "e", "piece", "id", "before"))).alias("edges"))
    return by_word.select("word", _ids(_fold(), pieces))


def _fold() -> Column:
    """Pieces of the whole word: for each position the one path that reaches it."""
    step = "struct(piece string, id int)".replace("(", "<").replace(")", ">").replace("piece ", "piece:").replace("id ", "id:")
    none = F.lit(None).cast(f"array<{step}>")
    start = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.when(i == 0, F.array().cast(f"array<{step}>")).otherwise(none))

    def extend(paths: Column, edge: Column) -> Column:
        path = F.element_at(paths, edge["s"] + 1)
        last = F.when(F.size(path) > 0, F.element_at(path, -1)["piece"]).otherwise("")
        fits = path.isNotNull() & F.array_contains(edge["before"], last)
        longer = F.concat(path, F.array(F.struct(edge["piece"].alias("piece"), edge["id"].alias("id"))))
        return F.transform(paths, lambda p, i: F.when(fits & (i == edge["e"]), longer).otherwise(p))

    return F.aggregate("edges", start, extend, lambda paths: F.element_at(paths, -1))


def _ids(path: Column, pieces: Pieces) -> Column:
    """Ids of a path; a piece without one becomes its byte pieces."""
    values = F.array(*[F.lit(pieces.bytes.get(b)).cast("int") for b in range(256)])

    def each(p: Column) -> Column:
        raw = F.hex(F.encode(p["piece"], "UTF-8"))
        units = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.element_at(values, F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(units)

    return F.flatten(F.transform(path, each)).alias("ids")


def encode(docs: DataFrame, model: str, limit: int = LATTICE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), n_pieces, round_trip (whether
    decoding the ids gives the text again; NULL text counts as empty)."""
    rows = id_text(docs, id_col, text_col)
    table = {r.word: array("i", r.ids).tobytes() for r in lattice_segments(stored(common_words(rows, model, limit), "lattice-words"), model).collect()}  # at most `limit` rows
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = load(model), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                found = [pieces.encode(t, known) for t in texts]
                whole = [pieces.decode(ids.tolist()) == (t or "") for ids, t in zip(found, texts)]
                sizes = np.array([len(f) for f in found], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.array([], np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes), pa.array(whole, pa.bool_())], ["doc_id", "ids", "n_pieces", "round_trip"])

    return rows.mapInArrow(each, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids give a NULL text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(each, "doc_id long, text string")
