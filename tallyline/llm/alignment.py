"""Alignment of two tokenizers over whole texts through anchors at white space.

Both tokenizers encode a whole text: a byte-level vocabulary (A) the text after a space, a piece
model (B), which adds that space itself, the text. A place where a token of A and one of B both
end and both next tokens begin with a space is an anchor. Anchors are verified on the bytes, so
nothing is assumed about words, and they cut a text into windows: short pairs of id tuples that
come back all over a corpus. A window is aligned once (where ends meet it is cut into groups, and
tokens that share a byte are linked) and then looked up by its ids; a text's alignment is that of
its windows in a row.

A text's distinct links go to a stored narrow table; the number of documents that hold a link is
one aggregation over it, and the highest number for an id of A another. Both are joined back to
the links: by a broadcast while there are at most ``SENT_LINKS`` different links in the corpus,
else by a shuffled join. Nothing reaches the driver.

Defined cases: a NULL or empty text, and one whose joined token bytes of A or B differ from the
space and the text (a text that holds the mark character, or that a model rewrites), has no
tokens: zeros and empty groups. Repeated rows are documents of their own; ids may be NULL.
Columns other than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import id_text, stored
from tallyline.llm.token_counts import WORDS, byte_letters

MARK = "▁"
SLICE = 128
CACHED_WINDOWS = 60_000
SENT_LINKS = 2_000_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>"
WEIGHTS = np.random.default_rng(13).integers(1, 1 << 63, 1024, np.uint64) | np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


class Side:
    """One tokenizer's tokens: their bytes, sizes, whether they begin with a space, and their ids as text."""

    def __init__(self, raw: list[bytes], ends: tuple[str, ...]) -> None:
        self.raw = raw
        self.size = np.array(list(map(len, raw)), np.int64)
        self.space = np.array([r[:1] == b" " for r in raw], bool)
        self.text = np.array([[f"{i}{e}" for e in ends] for i in range(len(raw))], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


class Memo:
    """Aligned windows by their id tuples: groups and links of each, and its groups as text."""

    def __init__(self) -> None:
        self.number: dict[tuple[bytes, bytes], int] = {}
        self.text: list[str] = []
        self.n_groups = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # where the links of each window begin, and the end
        self.links = np.zeros(0, np.uint64)

    def add(self, keys: list[tuple[bytes, bytes]], text: list[str], n_groups: np.ndarray, n_links: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.text), len(self.text) + len(keys))))
        self.text += text
        self.n_groups = np.concatenate((self.n_groups, n_groups))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n_links)))
        self.links = np.concatenate((self.links, links))


class Spans:
    """Runs of tokens in one long array: where each begins, and how many tokens it has."""

    def __init__(self, ids: np.ndarray, start: np.ndarray) -> None:
        self.ids, self.start = ids, start
        self.n = np.diff(np.append(start, len(ids)))

    def inside(self) -> np.ndarray:
        """The place of every token in its run."""
        return np.arange(len(self.ids)) - np.repeat(self.start, self.n)

    def like(self, other: np.ndarray) -> np.ndarray:
        """Whether each run holds the same tokens as the run ``other`` names for it."""
        if not len(self.start):
            return np.ones(0, bool)
        same = self.n == self.n[other]
        at = np.repeat(self.start[other], self.n) + self.inside()
        equal = self.ids[np.minimum(at, len(self.ids) - 1)] == self.ids
        return same & np.logical_and.reduceat(equal, self.start)

    def hashes(self) -> np.ndarray:
        return np.add.reduceat((self.ids.astype(np.uint64) + np.uint64(1)) * WEIGHTS[self.inside() % len(WEIGHTS)], self.start)

    def keys(self, which: np.ndarray) -> list[bytes]:
        raw = self.ids.tobytes()
        begin = (4 * self.start[which]).tolist()
        end = (4 * (self.start[which] + self.n[which])).tolist()
        return [raw[x:y] for x, y in zip(begin, end)]

    def taken(self, which: np.ndarray) -> "Spans":
        n = self.n[which]
        start = np.cumsum(n) - n
        at = np.repeat(self.start[which] - start, n) + np.arange(int(n.sum()))
        return Spans(self.ids[at], start)


class TwoVocabularies:
    """Both tokenizers and the windows aligned so far."""

    def __init__(self, byte_vocabulary: str, piece_model: str) -> None:
        with open(byte_vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        # The ranks of a byte-level vocabulary are its ids, so the faster library gives the same ids.
        self._bytes = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        raw_a = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            raw_a[i] = raw
        self.a = Side(raw_a, (",", "|"))
        self.b = Side([self._piece(i) for i in range(self._pieces.get_piece_size())], (",", ";", "\n"))
        self.memo = Memo()

    def _piece(self, i: int) -> bytes:
        if self._pieces.is_byte(i):
            return bytes([int(self._pieces.id_to_piece(i)[3:5], 16)])
        return self._pieces.id_to_piece(i).replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text; none where the bytes of the tokens are not those of the text."""
        out = []
        for text, b in zip(texts, self._pieces.encode(texts, num_threads=1)):
            a, whole = self._bytes.encode_ordinary(" " + text), b" " + text.encode()
            out.append((a, b) if text and self.a.joined(a) == whole and self.b.joined(b) == whole else ([], []))
        return out

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, str, np.ndarray]]:
        """(groups, links, groups as text, links as 32-bit id pairs) of each encoded text."""
        out = [(0, 0, "", self.memo.links[:0])] * len(encoded)
        texts = [n for n, (a, _) in enumerate(encoded) if a]
        if not texts:
            return out
        if len(self.memo.text) > CACHED_WINDOWS:
            self.memo = Memo()
        a, b = (Spans(np.concatenate([np.array(encoded[n][side], "<u4") for n in texts]), _starts([len(encoded[n][side]) for n in texts])) for side in (0, 1))
        from_a, from_b = anchors(self.a, a, self.b, b)
        first = np.searchsorted(from_a, a.start)  # the first window of each text
        numbers = self._numbers(Spans(a.ids, from_a), Spans(b.ids, from_b))
        memo = self.memo
        n_groups = np.add.reduceat(memo.n_groups[numbers], first)
        begin, n = memo.first[numbers], memo.first[numbers + 1] - memo.first[numbers]
        n_links = np.add.reduceat(n, first)
        links = memo.links[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        parts = list(map(memo.text.__getitem__, numbers.tolist()))
        ends, at = [*first[1:].tolist(), len(parts)], 0
        for text, x, y, groups, many in zip(texts, first.tolist(), ends, n_groups.tolist(), n_links.tolist()):
            out[text] = (groups, many, ";".join(parts[x:y]), links[at : at + many])
            at += many
        return out

    def _numbers(self, a: Spans, b: Spans) -> np.ndarray:
        """The memo's number of every window. Equal windows are brought together by a hash, their
        ids are compared, and one of each goes to the memo by its id tuples."""
        hashes = a.hashes() * WEIGHTS[0] + b.hashes() * WEIGHTS[1] + a.n.astype(np.uint64) * WEIGHTS[2]
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not (a.like(one[which]) & b.like(one[which])).all():
            one = which = np.arange(len(a.start))  # a clash of hashes: every window on its own
        keys = list(zip(a.keys(one), b.keys(one)))
        known = self.memo.number
        missing = {key: n for n, key in enumerate(keys) if key not in known}
        if missing:
            asked = one[np.fromiter(missing.values(), np.int64, len(missing))]
            self.memo.add(list(missing), *self._aligned(a.taken(asked), b.taken(asked)))
        return np.array([known[key] for key in keys], np.int64)[which]

    def _aligned(self, a: Spans, b: Spans) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(groups as text, number of groups, number of links, links) of windows in a row."""
        end_a, end_b = np.cumsum(self.a.size[a.ids]), np.cumsum(self.b.size[b.ids])
        # Between neighbouring ends of either side there is one token of each: a link.
        cuts = np.union1d(end_a, end_b)
        links = a.ids[np.searchsorted(end_a, cuts)].astype(np.uint64) << np.uint64(32) | b.ids[np.searchsorted(end_b, cuts)]
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        stops = end_a[a.start + a.n - 1]
        n_groups = np.diff(np.searchsorted(shared, stops, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(cuts, stops, "right"), prepend=0)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        # Tokens in the order of the text: those of A in a group, then those of B.
        in_a, in_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        out = np.empty(len(a.ids) + len(b.ids), object)
        out[np.arange(len(a.ids)) + (np.cumsum(in_b) - in_b)[group_a]] = self.a.text[a.ids, (shared[group_a] == end_a).astype(int)]
        closing = (shared[group_b] == end_b).astype(int)
        closing[b.start + b.n - 1] = 2
        out[np.arange(len(b.ids)) + np.cumsum(in_a)[group_b]] = self.b.text[b.ids, closing]
        return "".join(out.tolist()).split("\n")[:-1], n_groups, n_links, links


def _starts(sizes: list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes[:-1]])


def anchors(side_a: Side, a: Spans, side_b: Side, b: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin in the tokens of A and of B: at every text, and where both sides end and
    both next tokens begin with a space."""
    before = []
    for side, texts in ((side_a, a), (side_b, b)):
        marked = side.space[texts.ids]
        marked[texts.start] = True
        at = np.flatnonzero(marked)
        size = side.size[texts.ids]
        before.append((at, (np.cumsum(size) - size)[at]))
    (at_a, offset_a), (at_b, offset_b) = before
    _, x, y = np.intersect1d(offset_a, offset_b, assume_unique=True, return_indices=True)
    return at_a[x], at_b[y]


@lru_cache(maxsize=1)
def _load(byte_vocabulary: str, piece_model: str) -> TwoVocabularies:
    return TwoVocabularies(byte_vocabulary, piece_model)


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``) and links (distinct id pairs with their number in the text).

    The arguments are paths of the two vocabularies that every executor can read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _load(byte_vocabulary, piece_model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                encoded = both.encode(texts)
                aligned = both.align(encoded)
                counts = [(len(a), len(b), *found[:2]) for (a, b), found in zip(encoded, aligned)]
                yield _batch(part.column(0), counts, [found[2] for found in aligned], [np.unique(found[3], return_counts=True) for found in aligned])

    return id_text(docs, id_col, text_col).mapInArrow(each, SCHEMA)


def _batch(ids: pa.Array, counts: list[tuple], groups: list[str], links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *(len(k) for k, _ in links)]).astype(np.int32))
    keys = np.concatenate([k for k, _ in links]) if links else np.array([], np.uint64)
    times = np.concatenate([n for _, n in links]) if links else np.array([], np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (keys >> np.uint64(32), keys & LOW, times)], ["a", "b", "n"])
    numbers = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [()] * 4)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, pairs)], names)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold the link, and whether no other link of ``a``
    is held by more."""
    pairs = stored(aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("docs")), "alignment-links")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """``aligned`` (stored rows with links) with n_best and count_sum in place of the links."""
    rows = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    counted = stored(link_counts(rows), "alignment-counts")
    few = counted.limit(SENT_LINKS + 1).count() <= SENT_LINKS
    held = rows.select("row", F.explode("links").alias("l")).select("row", "l.a", "l.b", "l.n").join(F.broadcast(counted) if few else counted, ["a", "b"])
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("docs")).cast("long").alias("count_sum"))
    none = F.lit(0).cast("long")
    shown = rows.drop("links").join(sums, "row", "left")
    return shown.withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)}).drop("row")
