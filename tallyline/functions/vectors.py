"""Usage vectors in SQL expressions: validation, totals and differences.

A vector is six nullable counts. NULL means unknown and is never read as zero. Every
function takes the name of a struct column (or "" when the counts are plain columns) and
returns SQL text, so that one expression costs one call to the JVM when a plan is built.
"""

from __future__ import annotations

from tallyline.model import ACCOUNTING_V1, ACCOUNTING_V2, VECTOR_FIELDS

INVALID = "INVALID_USAGE"
OVERFLOW = "NUMERIC_OVERFLOW"
UNSUPPORTED = "UNSUPPORTED_FORMAT"
AMBIGUOUS = "AMBIGUOUS_USAGE"
MAX_LONG = 2**63 - 1
VECTOR_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in VECTOR_FIELDS) + ">"


def field(v: str, name: str) -> str:
    return f"{v}.{name}" if v else name


def _wide(text: str) -> str:
    return f"CAST({text} AS DECIMAL(20,0))"


def pack(**given: str) -> str:
    """A vector struct from SQL text per field; fields not given are unknown."""
    parts = [f"'{f}', CAST({given.get(f, 'NULL')} AS BIGINT)" for f in VECTOR_FIELDS]
    return f"named_struct({', '.join(parts)})"


def pack_columns(prefix: str = "") -> str:
    return pack(**{f: prefix + f for f in VECTOR_FIELDS})


def _breaks_containment(v: str) -> str:
    i, c, w = (field(v, n) for n in ("input_total", "cached_input", "cache_write_input"))
    o, r = field(v, "output_total"), field(v, "reasoning_output")
    negative = " OR ".join(f"{field(v, n)} < 0" for n in VECTOR_FIELDS)
    return f"coalesce({negative} OR {c} > {i} OR {w} > {i} OR {_wide(c)} + {_wide(w)} > {i} OR {r} > {o}, false)"


def total_error_v1(v: str) -> str:
    """Error code of the first total rule, NULL when the vector is acceptable."""
    parts = f"{_wide(field(v, 'input_total'))} + {_wide(field(v, 'output_total'))}"
    return (
        f"CASE WHEN {_breaks_containment(v)} THEN '{INVALID}'"
        f" WHEN {parts} > {MAX_LONG} THEN '{OVERFLOW}'"
        f" WHEN {parts} <> {field(v, 'reported_total')} THEN '{INVALID}' END"
    )


def _breaks_lower_bound(v: str) -> str:
    """A known part bounds its unknown whole from below."""
    known = {n: f"coalesce({_wide(field(v, n))}, 0)" for n in ("cached_input", "cache_write_input")}
    input_min = f"coalesce({_wide(field(v, 'input_total'))}, {known['cached_input']} + {known['cache_write_input']})"
    output_min = f"coalesce({field(v, 'output_total')}, {field(v, 'reasoning_output')}, 0)"
    return f"coalesce({input_min} + {output_min} > {field(v, 'reported_total')}, false)"


def total_error(v: str) -> str:
    """Error code of the current total rule, NULL when the vector is acceptable."""
    return f"coalesce({total_error_v1(v)}, CASE WHEN {_breaks_lower_bound(v)} THEN '{INVALID}' END)"


def raw_total(v: str) -> str:
    both = f"try_add({field(v, 'input_total')}, {field(v, 'output_total')})"
    return f"coalesce({both}, {field(v, 'reported_total')})"


def validated_total_v1(v: str) -> str:
    return f"CASE WHEN {total_error_v1(v)} IS NULL THEN {raw_total(v)} END"


def validated_total(v: str) -> str:
    """input + output, else the reported total, else NULL; NULL as well for a broken vector."""
    return f"CASE WHEN {total_error(v)} IS NULL THEN {raw_total(v)} END"


def published_error(v: str, version: str) -> str:
    return (
        f"CASE WHEN {version} = '{ACCOUNTING_V2}' THEN {total_error(v)}"
        f" WHEN {version} = '{ACCOUNTING_V1}' THEN {total_error_v1(v)} ELSE '{UNSUPPORTED}' END"
    )


def published_total(v: str, version: str) -> str:
    """Total under the version the fact was published with; a broken fact stops the query."""
    error = published_error(v, version)
    return f"CASE WHEN {error} IS NOT NULL THEN CAST(raise_error({error}) AS BIGINT) ELSE {raw_total(v)} END"


def noncached_input(v: str) -> str:
    """Input minus cached input when both are known; cache writes stay inside."""
    return f"{field(v, 'input_total')} - {field(v, 'cached_input')}"


def raw_difference(a: str, b: str) -> str:
    return pack(**{n: f"try_subtract({field(a, n)}, {field(b, n)})" for n in VECTOR_FIELDS})


def difference_error(a: str, b: str, difference: str) -> str:
    """Why a - b (already in the struct column ``difference``) is not a usable vector."""
    masks = " OR ".join(f"({field(a, n)} IS NULL) <> ({field(b, n)} IS NULL)" for n in VECTOR_FIELDS)
    shrinks = " OR ".join(f"coalesce({field(a, n)} < {field(b, n)}, false)" for n in VECTOR_FIELDS)
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {masks} THEN '{AMBIGUOUS}'"
        f" WHEN {shrinks} THEN '{INVALID}' ELSE {total_error(difference)} END"
    )


def comparable(a: str, b: str) -> str:
    known = [f"{field(v, n)} IS NOT NULL" for v in (a, b) for n in ("input_total", "output_total")]
    return "(" + " AND ".join(known) + ")"


def usage_vector_total(text: str) -> str:
    """Total of a vector kept as JSON text, NULL when it cannot be proven."""
    v = f"from_json({text}, '{VECTOR_TYPE}')"
    return f"transform(array({v}), v -> {validated_total('v')})[0]"


def vector_key(v: str) -> str:
    """A text with one value per distinct vector, for joins and hashing."""
    parts = ", ".join(f"coalesce(CAST({field(v, n)} AS STRING), '-')" for n in VECTOR_FIELDS)
    return f"CASE WHEN {v} IS NOT NULL THEN concat_ws(',', {parts}) END"
