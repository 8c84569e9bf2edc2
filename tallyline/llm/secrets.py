"""Secret scan: fixed patterns, and character Markov models for strings the patterns miss.

Two first-order character models are trained, one on random strings (what the fixed patterns
find as secrets, the labelled samples of that kind), one on ordinary identifiers (all other runs
of letters, digits and underscores of 8 or more). A run of 20 or more secret characters that
meets no fixed span is a secret if the log-likelihood ratio of the two models exceeds
``LEAST_RATIO``. The ratios of all pairs of characters are one table of at most 70 x 70 numbers;
only the pair counts (at most that many rows) reach the driver.

All steps are DataFrame functions. Counting is one pass over all texts with a shuffle of the pair
counts, combined first; scanning is one pass without a shuffle, and patterns are located only
in texts that hold a match.

Defined cases: NULL text is scanned as empty; no finds give the SHA-256 of the empty string.
Repeated rows give repeated rows. Without training strings of both kinds the models add
nothing. Offsets are code points, ends exclusive. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import id_text

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9_]{8,}"
LEAST_RATIO = 10.0  # natural units over a whole string
SCALE = 1000
BACKING = 5


def _located(text: Column, pattern: str, kind: int, value_group: int | None) -> Column:
    """Matches of a pattern as array<struct<start, kind, end>>, by the text between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda v: F.length(v) >= LEAST_ASSIGNED) if value_group else F.transform(hits, lambda _: F.lit(True))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), kept.alias("kept"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), nothing.alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["hit"]).alias("at"),
            F.when(s["kept"], F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + s["gap"] + s["hit"]).alias("end"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(nothing)


def _pairs(strings: Column) -> Column:
    inside = F.transform(strings, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return F.explode(F.flatten(inside)).alias("pair")


def train(docs: DataFrame) -> list[int]:
    """Log-likelihood ratios (times SCALE) of the pairs of ALPHABET, row by row; empty if one of
    the kinds has no samples. Counted over all texts."""
    found = id_text(docs).where("text IS NOT NULL")
    no = F.array().cast("array<string>")
    extract = lambda p, g: F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(g))).otherwise(no)
    secret = F.filter(F.concat(extract(ASSIGN, 1), extract(ACCESS, 0), extract(HEX, 0)), lambda s: F.length(s) >= LEAST_ASSIGNED)
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.when(rest.rlike(pattern), F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    ordinary = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    each = F.explode(F.array(F.struct(F.lit(1).alias("kind"), secret.alias("s")), F.struct(F.lit(0).alias("kind"), ordinary.alias("s")))).alias("e")
    pairs = found.select(each).select("e.kind", _pairs(F.col("e.s"))).groupBy("kind", "pair").agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    tables = [[[0] * size for _ in range(size)] for _ in range(2)]
    for row in pairs.where(F.col("pair").rlike(f"^[{ALPHABET[:-1]}-]{{2}}$")).collect():
        tables[row.kind][ALPHABET.index(row.pair[0])][ALPHABET.index(row.pair[1])] = row.n
    ordinary, random = map(_chances, tables)
    if not ordinary or not random:
        return []
    return [round(SCALE * math.log(random[i][j] / ordinary[i][j])) for i in range(size) for j in range(size)]


def _chances(counts: list[list[int]]) -> list[list[float]]:
    """Chance of each next character. A row leans on the overall chances as on BACKING more pairs,
    and those on one more of each character. Empty without any pair."""
    size, total = len(counts), sum(map(sum, counts))
    overall = [(sum(row[j] for row in counts) + 1) / (total + size) for j in range(size)]
    return [[(row[j] + BACKING * overall[j]) / (sum(row) + BACKING) for j in range(size)] for row in counts] if total else []


def _ratio(string: Column, model: list[int]) -> Column:
    table = F.expr("array(" + ",".join(map(str, model)) + ")")
    letter = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(string) - 1), F.lit(0), lambda a, i: a + F.element_at(table, (letter(i) - 1) * len(ALPHABET) + letter(i + 1)))


def scan(docs: DataFrame, model: list[int]) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (NULL as empty), base and spans, both arrays of
    struct(start, kind, end) by start, then kind: 0 assign, 1 access, 2 hex, 3 markov."""
    return _with_spans(id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)


def _with_spans(rows: DataFrame, model: list[int]) -> DataFrame:
    text = F.col("text")
    parts = [_located(text, ASSIGN, 0, 1), _located(text, ACCESS, 1, None), _located(text, HEX, 2, None)]
    found = rows.withColumn("base", F.array_sort(F.concat(*parts)))
    if not model:
        return found.withColumn("spans", F.col("base"))
    runs = _located(text, CANDIDATE, 3, None)
    meets = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    random = lambda s: _ratio(F.substring(text, s["start"] + 1, s["end"] - s["start"]), model) > int(LEAST_RATIO * SCALE)
    found = found.withColumn("markov", F.filter(runs, lambda s: ~meets(s) & random(s)))
    return found.withColumn("spans", F.when(F.size("markov") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "markov"))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[int], text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in the text replaced; NULL texts stay NULL. All columns stay."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _with_spans(rows.withColumn("text", F.coalesce("text", F.lit(""))), model)
    clean = F.when(F.col(f"__row.{text_col}").isNotNull(), redacted(F.col("text"), F.col("spans"), mask))
    return found.select(*[clean.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(walk)
