"""Exact totals of usage facts.

Sums have to be exact beyond 64 bits, but adding 38-digit decimals row by row is about ten
times slower than adding longs. Every count is therefore cut into three 21-bit limbs that
are summed as longs (safe for 4 * 10^12 rows of one group, and an overflow would raise
rather than wrap) and put together once per group as a decimal.

Distinct sessions and turns are counted in a second, narrow branch: it ships only the
distinct ids, spreads one hot session over its turns, and meets the sums in a last
aggregation over rows that are already one or two per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.model import MEASURES

LIMB_BITS = 21
LIMB_MASK = (1 << LIMB_BITS) - 1
DEC = "decimal(38,0)"
KNOWN_TURN = "(turn_id IS NOT NULL AND turn_id <> '')"


def limb_sums(value: str, name: str) -> list[Column]:
    """Partial-sum columns of a non-negative long, given as SQL text."""
    return [
        F.expr(f"sum(shiftright({value}, {2 * LIMB_BITS})) AS {name}__2"),
        F.expr(f"sum(shiftright({value}, {LIMB_BITS}) & {LIMB_MASK}) AS {name}__1"),
        F.expr(f"sum(({value}) & {LIMB_MASK}) AS {name}__0"),
    ]


def from_limbs(name: str) -> str:
    high, mid, low = (f"CAST({name}__{i} AS DECIMAL(20,0))" for i in (2, 1, 0))
    scale = f"CAST({1 << LIMB_BITS} AS DECIMAL(8,0))"
    wide = f"CAST(CAST({high} * {scale} + {mid} AS DECIMAL(30,0)) * {scale} + {low} AS {DEC})"
    # Most sums fit a long, which spares them the arithmetic of big decimals; NULL stays NULL either way.
    fits = f"{name}__2 = 0 AND {name}__1 < {1 << 40} AND {name}__0 < {1 << 61}"
    return f"CASE WHEN {fits} THEN CAST({name}__1 * {1 << LIMB_BITS} + {name}__0 AS {DEC}) ELSE {wide} END"


def exact_sum(df: DataFrame, keys: list[str], sums: dict[str, str], others: list[str] = []) -> DataFrame:
    """groupBy(keys) with exact decimal sums of longs (SQL text); NULL where no value is known.

    ``others`` are further aggregates as "expression AS name". Values must not be negative.
    """
    aggregates = [part for name, value in sums.items() for part in limb_sums(value, name)]
    grouped = df.groupBy(*keys).agg(*aggregates, *[F.expr(o) for o in others])
    names = [o.rsplit(" AS ", 1)[1] for o in others]
    return grouped.selectExpr(*keys, *names, *[f"{from_limbs(name)} AS {name}" for name in sums])


def with_noncached(facts: DataFrame) -> DataFrame:
    return facts.withColumn("noncached_input", F.expr("input_total - cached_input"))


def measure_sums(facts: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:
    """Per group: the total, each measure with the tokens it covers, and the counts.

    ``more`` are further aggregates as "expression AS name".
    """
    sums = {"total_tokens": "total_tokens"}
    others = [*more, "count(1) AS usage_event_count", f"count(CASE WHEN {KNOWN_TURN} THEN 1 END) AS turn_event_count"]
    for m in MEASURES:
        sums[m] = m
        sums[f"{m}_covered"] = f"CASE WHEN {m} IS NOT NULL THEN total_tokens END"
        others.append(f"count({m}) AS {m}_known")
    return exact_sum(with_noncached(facts), keys, sums, others)


def distinct_counts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sessions and distinct (session, turn) pairs per group."""
    ids = dict.fromkeys([*keys, "session_key"])
    pairs = facts.selectExpr(*ids, f"CASE WHEN {KNOWN_TURN} THEN turn_id END AS known_turn").distinct()
    per_session = pairs.groupBy(*ids).agg(F.expr("count(known_turn) AS turns"))
    if "session_key" in keys:
        return per_session.selectExpr(*keys, "CAST(1 AS BIGINT) AS session_count", "turns AS turn_count")
    return per_session.groupBy(*keys).agg(
        F.expr("count(session_key) AS session_count"), F.expr("sum(turns) AS turn_count")
    )


PARTIAL_SUMS = ("total_tokens", *MEASURES, *[f"{m}_covered" for m in MEASURES])
PARTIAL_COUNTS = ("usage_event_count", "turn_event_count", *[f"{m}_known" for m in MEASURES])
COUNTS = (*PARTIAL_COUNTS, "session_count", "turn_count")


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Add up partial sums of the same group; partials carry decimals already."""
    return partials.groupBy(*keys).agg(
        *[F.expr(f"sum(CAST({c} AS {DEC})) AS {c}") for c in PARTIAL_SUMS],
        *[F.expr(f"sum({c}) AS {c}") for c in COUNTS],
    )


def totals_expressions() -> list[str]:
    """Final totals columns over merged partials (all NULL for a group without facts).

    A value nobody knew stays NULL; nothing is complete when there are no events.
    """
    zero, events = f"CAST(0 AS {DEC})", "coalesce(usage_event_count, 0L)"
    columns = [f"coalesce(total_tokens, {zero}) AS total_tokens"]
    for m in MEASURES:
        columns += [
            f"{m}",
            f"coalesce({m}_covered, {zero}) AS {m}_covered",
            f"({events} > 0 AND coalesce({m}_known, 0L) = {events}) AS {m}_complete",
        ]
    return columns + [
        "coalesce(session_count, 0L) AS session_count",
        f"{events} AS usage_event_count",
        "nullif(turn_count, 0L) AS reliable_turn_count",
        f"({events} > 0 AND coalesce(turn_event_count, 0L) = {events}) AS reliable_turns_complete",
    ]


TOTALS_COLUMNS = (
    "total_tokens",
    *[f"{m}{suffix}" for m in MEASURES for suffix in ("", "_covered", "_complete")],
    "session_count",
    "usage_event_count",
    "reliable_turn_count",
    "reliable_turns_complete",
)


def present_totals(merged: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    return merged.selectExpr(*keys, *extra, *totals_expressions())


def partials_by(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable partial sums and counts of each group."""
    sums, counts = measure_sums(facts, keys), distinct_counts(facts, keys)
    return sums.unionByName(counts, allowMissingColumns=True)


def totals_by(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per group; NULL is a group of its own."""
    return present_totals(merge_partials(partials_by(facts, keys), keys), keys)


def totals(facts: DataFrame) -> DataFrame:
    """One row of totals, also for an empty set."""
    return totals_by(facts, [])


def sum_token_decimal(column: str) -> Column:
    """Exact sum of known non-negative counts, NULL when there is none."""
    checked = f"CASE WHEN {column} < 0 THEN CAST(raise_error('INVALID_USAGE') AS BIGINT) ELSE {column} END"
    return F.expr(f"sum(CAST({checked} AS {DEC}))")


def sum_money_atoms(column: str) -> Column:
    return F.expr(f"sum(CAST({column} AS {DEC}))")


def text_decimals(df: DataFrame) -> DataFrame:
    """Decimals as canonical digit strings: the form answers are given in."""
    if not any(f.dataType.typeName() == "decimal" for f in df.schema.fields):
        return df
    return df.selectExpr(
        *[
            f"CAST(`{f.name}` AS STRING) AS `{f.name}`" if f.dataType.typeName() == "decimal" else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )
