"""Sequences of fixed capacity from whole documents, by harmonic packing.

A document's token ids are cut so that almost every piece is an exact reciprocal of the
capacity: as long as more than ``capacity / WHOLE`` ids are left, the largest capacity // k that
fits is cut off (what is left shrinks with its square, so three or four pieces do); the short
rest is a piece of its own. A piece of length n has the class k = capacity // n, and a sequence
of class k takes k pieces, whatever they are: no search, no sorting, no shared state.

1. Every task packs what it reads by itself, in one pass: it counts the pieces of each class and
   writes a sequence whenever it has k of them. It holds fewer than k pieces of a class, about
   ten thousand in all, whatever it reads.
2. What is left open in the tasks is numbered over all tasks, class by class, and fills sequences
   of the same kind; a task adds one number per class to that.
3. Fewer than k pieces of each class are left now: about ten thousand short pieces for any
   number of documents. They are of different classes, so they go into the fullest sequence
   that still holds them, longest first, in one task of that bounded size.

Padding: a sequence of k exact pieces lacks less than k ids; short rests (an id in thirty) lack
up to one in ``WHOLE``; and the last sequences at most about one capacity.

Defined cases: a NULL or empty text is a document of the end id alone. Ids and rows may repeat
or be NULL. Columns other than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tallyline.llm.common import id_text, stored
from tallyline.llm.token_counts import byte_letters

WHOLE = 32  # pieces of at most capacity / WHOLE ids are not cut
CACHED_CHUNKS = 300_000
# Letters that are composed and have one lower case each, digits, and punctuation without angle
# brackets (special tokens have some).
PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=?-@\[-`{-~]+")
PLAIN_TEXT = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=?-@\[-`{-~' \t\n\r]*")
# Fixed value: the word pattern of the vocabulary's pre-tokenizer, for such parts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:;=?@\[-`{-~]+")
LONGEST_CACHED = 64
SLICE = 256
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, kind int, worker long, number long, sequence_id long, offset long"
# A sequence's number: the worker that filled it, its class, and how many of that class it had before.
CLASS_BITS, COUNT_BITS = 16, 24
OVER_ALL, AT_LAST = (1 << 22) - 2, (1 << 22) - 1  # workers' numbers that no task has


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n * WHOLE > capacity:
        piece = capacity // -(-capacity // n)
        out.append(piece)
        n -= piece
    return out + [n] if n else out


class WordBpe:
    """Ids of whole texts. No token crosses a space or a line feed, so the parts between them are
    encoded once and then looked up. A part made of plain letters, digits and punctuation is cut
    further, as the vocabulary's own pattern does; the library encodes what is left."""

    def __init__(self, path: str) -> None:
        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        self._new: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._merging, self._ids = _merging(path)

    def _library_ids(self, part: str) -> bytes:
        return array("I", self._library.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= CACHED_CHUNKS:
                self._words.clear()
            ids = self._ids
            found = self._words[word] = array("I", [ids[i] for i in self._merging.encode_ordinary(word + "\0")]).tobytes()
        return found

    def _miss(self, chunk: str) -> bytes:
        found = self._old.get(chunk)
        if found is None:
            if len(chunk) <= LONGEST_CACHED and PLAIN.fullmatch(chunk):
                found = b"".join(map(self._word, WORDS.findall(chunk.lower())))
            else:
                found = self._library_ids(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self._new) >= CACHED_CHUNKS:
                self._old, self._new = self._new, {"": b""}
            self._new[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids, 32 bits each, little-endian."""
        out = []
        if PLAIN_TEXT.fullmatch(text):
            known = self._words.get
            for word in WORDS.findall(text.lower()):
                found = known(word)
                out.append(self._word(word) if found is None else found)
            return b"".join(out)
        known, miss = self._new.get, self._miss
        for chunk in text.replace("\n", " ").split(" "):
            found = known(chunk)
            if found is None:
                found = miss(chunk)
                known = self._new.get
            out.append(found)
        return b"".join(out)


def _merging(path: str) -> tuple[tiktoken.Encoding, list[int]]:
    """The vocabulary's merges for one lower-case word, and the vocabulary's id of each of their ranks.

    A word's end is written as a zero byte, which joins the byte before it ahead of all merges.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, end = byte_letters(), model["end_of_word_suffix"]
    parts = lambda s: (s.removesuffix(end), end if s.endswith(end) else "")
    raw = lambda s: bytes(letters[c] for c in parts(s)[0]) + b"\0" * bool(parts(s)[1])
    written = {b: c for c, b in letters.items()}
    pieces = [written[b] for b in range(256)] + [written[b] + end for b in range(256)]
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pieces.append(a + b)
    ranks = {raw(piece): rank for rank, piece in enumerate(pieces)}
    if len(ranks) != len(pieces):
        raise ValueError("a piece is made by two merges")
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), [model["vocab"][piece] for piece in pieces]


@lru_cache(maxsize=2)
def _load(path: str) -> WordBpe:
    return WordBpe(path)


def sequence_number(worker: int, kind: int, count: int) -> int:
    return (worker << CLASS_BITS | kind) << COUNT_BITS | count


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (32 bits
    each, little-endian), doc_tokens, sequence_id, offset (of the piece in its sequence).

    ``vocabulary`` is the path of a tokenizer file that every executor can read; ``end_id`` ends
    each document.
    """
    if not WHOLE <= capacity < 1 << CLASS_BITS:
        raise ValueError(f"capacity must be {WHOLE} to {(1 << CLASS_BITS) - 1}")
    end = np.asarray([end_id], "<u4").tobytes()
    plans = [cut_lengths(n, capacity) for n in range(capacity)]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, worker = _load(vocabulary), TaskContext.get().partitionId()
        open_pieces: dict[int, list[list]] = defaultdict(list)
        counts: dict[int, int] = defaultdict(int)
        out: list[list] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (bpe.encode(text) if text else b"") + end
                    total, start = len(ids) // 4, 0
                    for length in [capacity] * (total // capacity) + plans[total % capacity]:
                        kind = capacity // length
                        pieces = open_pieces[kind]
                        offset = pieces[-1][9] + pieces[-1][2] if pieces else 0
                        pieces.append([doc_id, start, length, ids[4 * start : 4 * (start + length)], total, kind, worker, None, None, offset])
                        start += length
                        if len(pieces) == kind:
                            number = sequence_number(worker, kind, counts[kind])
                            counts[kind] += 1
                            for piece in pieces:
                                piece[8] = number
                            out += pieces
                            pieces.clear()
                yield _rows(out)
                out = []
        for pieces in open_pieces.values():
            for number, piece in enumerate(pieces):
                piece[7], piece[9] = number, None
            out += pieces
        yield _rows(out)

    pieces = stored(id_text(docs, id_col, text_col).mapInArrow(fill, PIECES), "packing-pieces")
    shown = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    # Pieces left open, numbered over all tasks: the counts of the tasks before, then their own.
    left = pieces.where("sequence_id IS NULL")
    counts = left.groupBy("kind", "worker").agg(F.count("*").alias("n"))
    by_kind = Window.partitionBy("kind")
    starts = counts.select(
        "kind", "worker",
        F.coalesce(F.sum("n").over(by_kind.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_kind).alias("of_kind"),
    )
    numbered = left.join(starts, ["kind", "worker"]).withColumn("number", F.col("before") + F.col("number"))
    numbered = numbered.withColumn("bin", F.floor(F.col("number") / F.col("kind")).cast("long"))
    numbered = stored(numbered.withColumn("full", F.expr("bin < of_kind div kind")), "packing-left")
    inside = Window.partitionBy("kind", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # at most `kind` pieces
    over_all = numbered.where("full").select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.shiftleft(F.lit(OVER_ALL << CLASS_BITS).cast("long") + F.col("kind"), COUNT_BITS) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )

    # At most kind - 1 pieces of each class, so one task holds them whatever the number of documents.
    rest = numbered.where("NOT full").select(F.lit(0).alias("all"), "kind", "number", "length")
    placed = rest.groupBy("all").applyInPandas(lambda rows: best_fit(rows, capacity), "kind int, number long, sequence_id long, offset long")
    at_last = numbered.where("NOT full").drop("sequence_id", "offset").join(placed, ["kind", "number"]).select(*shown)
    return pieces.where("sequence_id IS NOT NULL").select(*shown).unionByName(over_all).unionByName(at_last)


def best_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest piece first into the fullest sequence that holds it."""
    rows = rows.sort_values(["length", "kind", "number"], ascending=[False, True, True])
    room: list[tuple[int, int]] = []  # (free, sequence), ascending
    opened, sequences, offsets = 0, [], []
    for length in rows["length"]:
        at = bisect_left(room, (length, -1))
        free, sequence = room.pop(at) if at < len(room) else (capacity, opened)
        opened += sequence == opened
        sequences.append(sequence_number(AT_LAST, 0, sequence))
        offsets.append(capacity - free)
        insort(room, (free - int(length), sequence))
    return pd.DataFrame({"kind": rows["kind"], "number": rows["number"], "sequence_id": sequences, "offset": offsets})


def _rows(pieces: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*pieces)) if pieces else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split(" ")[0] for c in PIECES.split(", ")])
