"""Removal of long repeats by sparse suffix arrays in a logarithmic family of levels.

A byte is removed if a 200-byte string that covers it also starts anywhere else, in the same text
or another. Texts are UTF-8 bytes; matches never cross texts; strings are judged on the input.

Sparse suffix arrays. Every 200-byte window elects one of the suffixes that start in its first
137 places, the one whose 64-byte prefix has the least hash. Equal windows elect the same place,
so equal windows always meet at suffixes with equal prefixes, and about one suffix in sixty has to
be kept. Suffixes are ordered by the hash of that prefix: the order among different prefixes
does not matter to the search, equal ones are adjacent. An entry (prefix hash, occurrences)
stands for all suffixes of a run with that prefix, so a level is no larger than its distinct text.

Logarithmic family. Texts come in batches. A new batch's array is merged with level 0 if that is
taken, the result with level 1, and so on, as in a binary counter (one merge for the whole
cascade), and scanned against the levels above. A merge or a scan is a grouped sum or a join on
the prefix hash; prefixes that occur more than once are the long-match candidates.

Exact matching. Windows of a kept suffix lie in one stretch of text, its span. Spans that are equal
as a whole, with equal places of their windows, match in all windows. Where a prefix has several
different spans, one of each is read again and the windows are compared one by one by their
hash together with prefix and offset, in groups of at most about ``GROUP_SPANS`` spans. A prefix
with more spans is dealt over several groups; what is alone in its group is then looked for in
the others by a distributed count, to which every group gives each of its windows once. Hashes
have 64 bits and take in the prefix's.

Scale: shuffled are the kept suffixes (narrow rows, about a seventh of the text), the candidates,
and the texts twice (to read the spans, and to cut). Hot prefixes combine before the shuffle
or are split by skewed joins. Intermediate tables lie in the shared folder.

Defined cases: a NULL text is empty. A row is known by its id and a hash of its text, so NULL
and repeated ids are ordinary; repeated rows are each other's copies. Texts under 200 bytes lose
nothing. Texts of any length are read in slices. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import discard, id_text, stored

LENGTH = 200
BATCHES = 4
GROUP_SPANS = 4096
PREFIX = 64  # bytes of a suffix that its order is decided by
WINDOWS = LENGTH - PREFIX + 1
SLICE = 1 << 18
_POSITION_BITS = 20


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of two neighbouring hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    x += b * np.uint64(0xC2B2AE3D27D4EB4F + 4 * salt)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64), np.arange(1001, 1257, dtype=np.uint64), 99)


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the PREFIX and of the 2 * PREFIX bytes that start at each position."""
    h, width = BYTES[data], 1
    while width < PREFIX:
        h = _mixed(h[:-width], h[width:], width)
        width *= 2
    return h, _mixed(h[:-width], h[width:], width)


def suffix_samples(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Samples of a buffer of texts laid end to end: (position, first window, last window,
    prefix hash, span hash), positions in the buffer.

    Each window of LENGTH bytes elects the position of its least prefix hash, the first among
    equals; equal windows elect the same place. ``ends``: where each text ends.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    short, wide = hashes(data)
    order = short & ~np.uint64((1 << _POSITION_BITS) - 1) | np.arange(len(short), dtype=np.uint64)
    least, width = order, 1
    while 2 * width <= WINDOWS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOWS:
        least = np.minimum(least[: n - LENGTH + 1], least[WINDOWS - width : n - LENGTH + 1 + WINDOWS - width])
    elected = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    # Windows inside one text.
    inside = np.ones(n - LENGTH + 1, bool)
    for end in ends[:-1]:
        inside[max(0, end - LENGTH + 1) : end] = False
    start = np.nonzero(inside & np.concatenate(([True], (elected[1:] != elected[:-1]) | ~inside[:-1])))[0]
    if not len(start):
        return none
    stop = np.nonzero(inside & np.concatenate(((elected[1:] != elected[:-1]) | ~inside[1:], [True])))[0]
    at = elected[start]
    size = stop + LENGTH - start
    span = _mixed(wide[start], wide[stop + LENGTH - 2 * PREFIX], 7)
    span = _mixed(span, wide[np.minimum(start + 2 * PREFIX, stop + LENGTH - 2 * PREFIX)], 11)
    span = _mixed(span, (size * LENGTH + at - start).astype(np.uint64), 13)
    return at, start, stop, short[at], span


def _sampled(docs: DataFrame) -> DataFrame:
    """(key, tag, at, lo, hi, prefix, span) of the kept suffixes; offsets in bytes of the text."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Buffers of about SLICE bytes: row numbers, offsets of the parts in their texts, parts."""
        numbers, offsets, parts, size = [], [], [], 0
        for i, text in enumerate(batch.column(2)):
            raw = text.as_buffer()
            if raw is None or raw.size < LENGTH:
                continue
            for at in range(0, raw.size - LENGTH + 1, SLICE):
                part = raw[at : at + SLICE + LENGTH - 1]
                if size and size + part.size > SLICE:
                    yield numbers, offsets, parts
                    numbers, offsets, parts, size = [], [], [], 0
                numbers.append(i)
                offsets.append(at)
                parts.append(part)
                size += part.size
        if parts:
            yield numbers, offsets, parts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, offsets, parts in rows(batch):
                ends = np.cumsum([p.size for p in parts])
                at, lo, hi, prefix, span = suffix_samples(np.frombuffer(b"".join(parts), np.uint8), ends)
                part = np.searchsorted(ends, lo, side="right")
                shift = np.array(offsets)[part] - np.concatenate(([0], ends[:-1]))[part]
                owner = pa.array(np.array(numbers)[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array((x + shift).astype(np.int32)) for x in (at, lo, hi)), pa.array(prefix.view(np.int64)), pa.array(span.view(np.int64))],
                    ["key", "tag", "at", "lo", "hi", "prefix", "span"],
                )

    return docs.mapInArrow(each, "key long, tag int, at int, lo int, hi int, prefix long, span long")


class SuffixLevels:
    """Sparse suffix arrays of all batches seen, level k holding 2 ** k of them."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self._found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Merge-scan a batch of suffixes (prefix): into the levels it fills, against the others."""
        run = batch.groupBy("prefix").agg(F.count("*").alias("n"))
        level, used = 0, []
        while level in self.levels:
            used.append(self.levels.pop(level))
            level += 1
        if used:
            for table in used:
                run = run.unionByName(table)
            run = run.groupBy("prefix").agg(F.sum("n").alias("n"))
        merged = stored(run, "suffix-level")
        for table in self.levels.values():
            self._found.append(stored(merged.select("prefix").join(table.select("prefix"), "prefix"), "suffix-matches"))
        for table in used:
            discard(table)
        self.levels[level] = merged

    def repeated(self) -> DataFrame:
        """Prefixes that occur more than once in all batches."""
        found = [table.where("n > 1").select("prefix") for table in self.levels.values()] + self._found
        out = found[0]
        for table in found[1:]:
            out = out.union(table)
        return out.distinct() if len(found) > 1 else out


def _window_keys(slices: list[bytes], prefix: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Keys of the windows of spans laid end to end: their hash with prefix and offset."""
    buffer = np.frombuffer(b"".join(slices), np.uint8)
    wide = hashes(buffer)[1]
    start = np.concatenate(([0], np.cumsum([len(s) for s in slices])[:-1]))
    number = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(start, windows) + number
    offset = (np.repeat(before, windows) - number).astype(np.uint64)
    key = _mixed(wide[at], wide[at + LENGTH - 2 * PREFIX], 17)
    return _mixed(key, _mixed(np.repeat(prefix.view(np.uint64), windows), offset, 19), 23)


def _ranges(hit: np.ndarray, windows: np.ndarray) -> list[list[dict]]:
    """Runs of hit windows of each span, as first and last window."""
    ends = np.cumsum(windows)
    owner = np.repeat(np.arange(len(windows)), windows)
    edge = np.concatenate(([True], owner[1:] != owner[:-1])) if len(hit) else np.zeros(0, bool)
    first = np.nonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))[0]
    last = np.nonzero(hit & (np.concatenate((edge[1:], [True])) | ~np.concatenate((hit[1:], [False]))))[0]
    out: list[list[dict]] = [[] for _ in windows]
    for a, b in zip(first.tolist(), last.tolist()):
        i = owner[a]
        begin = int(ends[i] - windows[i])
        out[i].append({"a": a - begin, "b": b - begin})
    return out


def _compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows that spans of one prefix share, for whole groups of spans.

    Of spans that are part of a larger group (parts > 1), ``open`` are the windows seen once here,
    and ``known`` has each other window once, at one of its spans.
    """
    prefix, span, before, windows, parts = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
    keys = _window_keys(batch.column(6).to_pylist(), prefix, before, windows)
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    ranges = pa.array(_ranges(hit, windows), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    owner = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(keys)) - np.repeat(np.cumsum(windows) - windows, windows)
    larger = parts[owner] > 1
    alone = np.nonzero(larger & ~hit)[0]
    leads = np.zeros(len(keys), bool)
    leads[first] = True
    leads = np.nonzero(larger & hit & leads)[0]
    offsets = lambda at: pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[at], minlength=len(windows))))).astype(np.int32))
    signed = keys.view(np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(number[alone].astype(np.int32)), pa.array(signed[alone])], ["a", "window"])
    return pa.RecordBatch.from_arrays(
        [pa.array(prefix), pa.array(span), ranges, pa.ListArray.from_arrays(offsets(alone), pairs), pa.ListArray.from_arrays(offsets(leads), pa.array(signed[leads]))],
        ["prefix", "span", "ranges", "open", "known"],
    )


def _shared_windows(slices: DataFrame) -> DataFrame:
    """(prefix, span, ranges) for distinct spans (prefix, span, before, windows, spans, slice)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            prefix, part = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            starts = np.nonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))))[0]
            at = 0
            for end in starts[1:]:  # the last group may go on
                if end - at >= GROUP_SPANS or end == starts[-1]:
                    yield _compared(batch.slice(at, end - at))
                    at = end
            rest = batch.slice(at)
        if rest is not None:
            yield _compared(rest)

    parts = F.ceil(F.col("spans") / GROUP_SPANS).cast("int")
    dealt = slices.withColumn("parts", parts).withColumn("part", F.pmod(F.hash("span"), F.col("parts")).cast("int"))
    dealt = dealt.select("prefix", "span", "before", "windows", "parts", "part", "slice").repartition("prefix", "part").sortWithinPartitions("prefix", "part")
    found = dealt.mapInArrow(compared, "prefix long, span long, ranges array<struct<a:int,b:int>>, open array<struct<a:int,window:long>>, known array<long>")
    found = stored(found, "suffix-compared")
    # Every part of a group names each of its windows once; what several parts name is shared.
    named = found.select(F.explode(F.concat(F.transform("open", lambda w: w["window"]), "known")).alias("window"))
    shared = named.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    across = found.select("prefix", "span", F.explode("open").alias("w")).select("prefix", "span", F.col("w.a").alias("a"), F.col("w.window").alias("window")).join(shared, "window")
    across = across.groupBy("prefix", "span").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("ranges"))
    return found.select("prefix", "span", "ranges").union(across)


def repeated_runs(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(key, tag, runs): for rows of ``docs`` (key, tag, text) that lose bytes, stretches
    (start, end) that repeated strings cover, in no order, possibly overlapping."""
    samples = _sampled(docs).withColumn("batch", F.pmod(F.xxhash64("key", "tag"), F.lit(batches)).cast("int"))
    samples = stored(samples, "suffix-samples", ["batch"])
    family = SuffixLevels()
    for number in range(batches):
        family.add(samples.where(F.col("batch") == number).select("prefix"))
    repeated = stored(family.repeated(), "suffix-repeated")
    found = stored(samples.drop("batch").join(repeated, "prefix"), "suffix-found")
    discard(samples)
    spans = found.groupBy("prefix", "span").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "tag", "at", "lo", "hi"), F.xxhash64("key", "tag", "lo")).alias("one"))
    spans = stored(spans, "suffix-spans")
    several = spans.groupBy("prefix").agg(F.count("*").alias("spans")).where("spans > 1")
    wanted = spans.join(several, "prefix").select("prefix", "span", "spans", "one.*")
    by_text = wanted.groupBy("key", "tag").agg(F.collect_list(F.struct("prefix", "span", "spans", "at", "lo", "hi")).alias("wanted"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for text, spans in zip(batch.column(0), batch.column(1)):
                raw, spans = text.as_buffer(), spans.as_py()
                for k in range(0, len(spans), 4096):
                    part = spans[k : k + 4096]
                    yield pa.RecordBatch.from_pylist(
                        [{"prefix": s["prefix"], "span": s["span"], "spans": s["spans"], "before": s["at"] - s["lo"], "windows": s["hi"] - s["lo"] + 1, "slice": raw[s["lo"] : s["hi"] + LENGTH].to_pybytes()} for s in part],
                        pa.schema([("prefix", pa.int64()), ("span", pa.int64()), ("spans", pa.int64()), ("before", pa.int32()), ("windows", pa.int32()), ("slice", pa.binary())]),
                    )

    slices = docs.join(by_text, ["key", "tag"]).select("text", "wanted").mapInArrow(cut, "prefix long, span long, spans long, before int, windows int, slice binary")
    ranges = stored(_shared_windows(stored(slices, "suffix-slices")), "suffix-ranges")
    alone = spans.where("n = 1").select("prefix", "span", "one.*").join(ranges, ["prefix", "span"])
    alone = alone.select("key", "tag", "lo", F.explode("ranges").alias("r")).select("key", "tag", (F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.b") + LENGTH).alias("end"))
    whole = found.join(spans.where("n > 1").select("prefix", "span"), ["prefix", "span"]).select("key", "tag", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    return whole.union(alone).groupBy("key", "tag").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.hash(text).alias("tag"), text.alias("text"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``with_text`` also kept (bytes; a cut may fall inside a character) and
    spans (start, end of each removed run)."""
    rows = keyed(docs, id_col, text_col)
    runs = stored(repeated_runs(rows.select("key", "tag", "text"), batches), "suffix-runs")
    more = ", kept binary, spans array<struct<start:int,end:int>>" if with_text else ""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                merged = _merged(runs.as_py() or [])
                ends = [0, *(x for run in merged for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                row = (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [{"start": a, "end": b} for a, b in merged]) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                kinds += [pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                names += ["kept", "spans"]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    joined = rows.join(runs, ["key", "tag"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def _merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
