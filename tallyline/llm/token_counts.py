"""Exact token counts of every prefix of a text, for a byte-level BPE vocabulary.

A text is cut into chunks at spaces where no token can cross; each chunk is cut into words by
the vocabulary's own pattern, and each word is walked once by ``PrefixBpe``. Per text the
operator keeps one 16-bit difference per UTF-8 byte: their running sum is the token count of
the prefix, so truncation and budget questions need no second encoding.

Nothing is shuffled; a task holds one Arrow batch and a bounded cache of chunks.

Defined cases: a NULL text counts as empty (0 bytes, 0 tokens, empty ``prefix_deltas``).
Repeated rows give repeated results. A count is exact at every character boundary; between
the bytes of one character it is that of the bytes seen so far. Columns other than the id and
the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from tallyline.llm.bpe import PrefixBpe
from tallyline.llm.common import id_text

# Fixed value: the word pattern of the vocabulary's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# Words whose two-character prefix is two words.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
# A space between two characters that are not white space: no word goes across its left side.
BETWEEN = re.compile(r" (?=\S)(?<=\S )")
CACHED_CHUNKS = 250_000
LONGEST_CACHED = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, fit_bytes long, prefix_deltas binary"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


def _steps(counts: list[int]) -> bytes:
    return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()


class ByteBpe:
    """Prefix counts of texts for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = {tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)): n for n, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.bpe = PrefixBpe(self.ids, lambda a, b: merges.get((a, b)))
        self._words = regex.compile(WORDS)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._counted: dict[bytes, array] = {}

    def chunk_counts(self, chunk: str) -> list[int]:
        """Token counts of the byte prefixes of a chunk that starts at a word boundary."""
        counts: list[int] = []
        before, blank = 0, None  # blank: (tokens before the last word, its text) if it was white space
        for word in self._words.findall(chunk):
            raw = word.encode()
            inside = self._word(raw)
            here = [before + c for c in inside[1:]]
            if word in LONG_CONTRACTIONS:
                here[1] = before + 2
            if blank and word[0].isspace():
                # A prefix that ends here has its white space in one word.
                run = (blank[1] + word[0]).encode()
                here[len(word[0].encode()) - 1] = blank[0] + self.bpe.prefixes(run)[0][-1]
            counts += here
            blank = (before, word) if word.isspace() else None
            before += inside[-1]
        return counts

    def _word(self, raw: bytes) -> list[int] | array:
        found = self._counted.get(raw)
        if found is None:
            found = self.bpe.prefixes(raw)[0]
            if len(raw) <= LONGEST_CACHED:
                if len(self._counted) >= CACHED_CHUNKS:
                    self._counted.clear()
                self._counted[raw] = array("h", found)
        return found

    def _miss(self, rest: str) -> bytes:
        """16-bit differences of the counts of a chunk, given without its leading space."""
        found = self._old.get(rest)
        if found is None:
            found = _steps(self.chunk_counts(" " + rest))
        if len(rest) <= LONGEST_CACHED:
            if len(self._new) >= CACHED_CHUNKS:
                self._old, self._new = self._new, {}
            self._new[rest] = found
        return found

    def _section(self, text: str) -> tuple[list[bytes], str]:
        """Differences of a text without special strings, and its last chunk."""
        first, *rest = BETWEEN.split(text)
        out = [_steps(self.chunk_counts(first))]
        for part in rest:
            found = self._new.get(part)
            out.append(self._miss(part) if found is None else found)
        return out, " " + rest[-1] if rest else first

    def text_deltas(self, text: str) -> bytes:
        """The differences of the token counts of all byte prefixes of a text, 16 bits each."""
        if not self.special or not any(s in text for s in self.special):
            return b"".join(self._section(text)[0])
        out: list[bytes] = []
        tail = ""
        for n, section in enumerate(self._split.split(text)):
            if n % 2:
                # Inside the special string a prefix is ordinary text that goes on from the tail.
                at = self._total(tail)
                counts = [self._total(tail + section[:k]) - at for k in range(1, len(section))]
                out.append(_steps([*counts, 1]))
                tail = ""
            elif section:
                steps, tail = self._section(section)
                out += steps
        return b"".join(out)

    def _total(self, chunk: str) -> int:
        return self.chunk_counts(chunk)[-1] if chunk else 0


@lru_cache(maxsize=2)
def _load(path: str) -> ByteBpe:
    return ByteBpe(path)


def count_prefixes(docs: DataFrame, vocabulary: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, fit_bytes, prefix_deltas.

    ``fit_bytes`` is the length of the longest prefix, ending between two characters, such that
    it and all shorter ones have at most ``budget`` tokens. ``prefix_deltas``: see the module. ``vocabulary`` is the
    path of a byte-level BPE file that every executor can read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                deltas = bpe.text_deltas(text) if text else b""
                steps = np.frombuffer(deltas, "<i2")
                total = int(steps.sum(dtype=np.int64))
                fit = len(steps)
                if total > budget or len(steps) > budget:
                    over = np.cumsum(steps, dtype=np.int64) > budget
                    if over.any():
                        fit = int(over.argmax())
                        raw = text.encode()
                        while fit and raw[fit] & 0xC0 == 0x80:
                            fit -= 1
                rows.append((len(steps), total, fit, deltas))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_tokens", "fit_bytes", "prefix_deltas"])

    return id_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)


def tokens_at(prefix_deltas: Column, n_bytes: Column) -> Column:
    """Tokens of the first ``n_bytes`` bytes of a text, from its differences alone."""
    return F.pandas_udf(_tokens_at, LongType())(prefix_deltas, n_bytes)


def _tokens_at(prefix_deltas: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or n is None or n != n else int(np.frombuffer(d, "<i2")[: int(n)].sum(dtype=np.int64)) for d, n in zip(prefix_deltas, n_bytes)], dtype="Int64")
