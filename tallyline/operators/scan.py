"""Ordered scans over groups of any size.

A running value over one huge group would sort the whole group in one task. Here a group
is cut into chunks by a deterministic chunk number that rises with the order (a block of
bytes, a day, a range of ordinals). Each chunk is scanned on its own, one small summary per
chunk is carried along the chunks of its group, and the carry is joined back. The rows
themselves are shuffled once, by (group, chunk), so a hot group spreads over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, IntegralType, StringType


def _never_null(key: str, kind: DataType) -> tuple[list[Column], str]:
    """Columns without NULLs that are equal exactly where ``key`` is, NULL being equal to NULL, and
    how the key comes back from them."""
    if isinstance(kind, StringType | IntegralType):
        nothing = F.lit("" if isinstance(kind, StringType) else 0).cast(kind)
        return [F.coalesce(F.col(key), nothing), F.col(key).isNull()], "CASE WHEN NOT {1} THEN {0} END"
    return [F.struct(F.col(key).alias("k"))], "{0}.k"


def chunked_scan(
    rows: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    *,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add running columns in group order; all inputs are SQL text over the rows.

    ``chunk`` is a number that never falls along ``order`` within a group.
    ``sums``: running sum including the row.
    ``lasts``: last non-NULL value up to and including the row.
    ``previous``: the value of the row before, NULL on the first row of a group.

    Rows meet their carry by the columns they were dealt by, so they are not dealt again; a null-safe
    join of the keys themselves is planned over other columns and would.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    safe, back = {}, {}
    for i, k in enumerate(keys):
        columns, text = _never_null(k, rows.select(k).schema[0].dataType)
        safe |= {f"__g_{i}_{n}": c for n, c in enumerate(columns)}
        back[k] = F.expr(text.format(*[f"__g_{i}_{n}" for n in range(len(columns))])).alias(k)
    work = rows.withColumns(safe | {"__chunk": F.expr(f"CAST({chunk} AS BIGINT)")})
    inputs = {f"__s_{n}": e for n, e in sums.items()}
    inputs |= {f"__l_{n}": e for n, e in lasts.items()}
    # Wrapped so that a NULL value of the row before stays apart from "no row before".
    inputs |= {f"__p_{n}": f"struct({e} AS v)" for n, e in previous.items()}
    work = work.withColumns({n: F.expr(e) for n, e in inputs.items()})

    here = Window.partitionBy(*safe, "__chunk").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__ls_{n}": F.sum(f"__s_{n}").over(upto) for n in sums}
    local |= {f"__ll_{n}": F.last(f"__l_{n}", ignorenulls=True).over(upto) for n in lasts}
    local |= {f"__lp_{n}": F.lag(f"__p_{n}").over(here) for n in previous}
    scanned = work.withColumns(local)

    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summary = [F.sum(f"__s_{n}").alias(f"__cs_{n}") for n in sums]
    summary += [F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), at)).alias(f"__cl_{n}") for n in lasts]
    summary += [F.max_by(f"__p_{n}", at).alias(f"__cp_{n}") for n in previous]
    chunks = work.groupBy(*safe, "__chunk").agg(*summary)
    before = Window.partitionBy(*safe).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = [F.sum(f"__cs_{n}").over(before).alias(f"__ks_{n}") for n in sums]
    carries += [F.last(f"__cl_{n}", ignorenulls=True).over(before).alias(f"__kl_{n}") for n in lasts]
    carries += [F.last(f"__cp_{n}", ignorenulls=True).over(before).alias(f"__kp_{n}") for n in previous]
    carried = chunks.select(*[F.col(g).alias(f"__k{g}") for g in safe], F.col("__chunk").alias("__k_chunk"), *carries)

    same = F.col("__chunk") == F.col("__k_chunk")
    for g in reversed(safe):
        same = (F.col(g) == F.col(f"__k{g}")) & same
    joined = scanned.join(carried, same, "left")
    result = [back[c] if c in back else F.col(c) for c in rows.columns]
    result += [(F.coalesce(F.col(f"__ls_{n}"), F.lit(0)) + F.coalesce(F.col(f"__ks_{n}"), F.lit(0))).alias(n) for n in sums]
    result += [F.coalesce(F.col(f"__ll_{n}"), F.col(f"__kl_{n}")).alias(n) for n in lasts]
    result += [F.coalesce(F.col(f"__lp_{n}"), F.col(f"__kp_{n}"))["v"].alias(n) for n in previous]
    return joined.select(*result)
