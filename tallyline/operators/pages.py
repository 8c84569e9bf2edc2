"""Ordered pages with keyset continuation, and the latest row per key.

A page is the next ``size`` rows after a position, read with one top-k pass. One row more
than the page is returned as a probe; ``has_more`` tells whether it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.filters import validate_page


def after(descending: str | None, ascending: str, position: tuple | None) -> Column:
    """Rows behind a position in the order (descending DESC, ascending ASC)."""
    if position is None:
        return F.lit(True)
    value, key = position
    return (F.col(descending) < F.lit(value)) | ((F.col(descending) == F.lit(value)) & (F.col(ascending) > F.lit(key)))


def page(rows: DataFrame, descending: str, ascending: str, size: int, position: tuple | None = None) -> DataFrame:
    """A page in (descending DESC, ascending ASC) order, plus one probe row when there is more."""
    validate_page(size)
    kept = rows if position is None else rows.where(after(descending, ascending, position))
    return kept.orderBy(F.desc(descending), F.asc(ascending)).limit(size + 1)


def key_page(rows: DataFrame, key: str, size: int, position: str | None = None, started: bool = False) -> DataFrame:
    """A page in key order with the unknown key first; ``started`` means the unknown was shown."""
    validate_page(size)
    if position is not None:
        rows = rows.where(F.col(key) > F.lit(position))
    elif started:
        rows = rows.where(F.col(key).isNotNull())
    return rows.orderBy(F.asc_nulls_first(key)).limit(size + 1)


def split_probe(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """The page rows with has_more; ``rows`` is a page, so it is at most 201 rows."""
    from pyspark.sql import Window

    numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    more = numbered.agg((F.count(F.lit(1)) > size).alias("has_more"))
    return numbered.where(F.col("place") <= size).drop("place").join(F.broadcast(more), F.lit(True))


def latest_by(rows: DataFrame, keys: list[str], time: str, tie: str, values: list[str]) -> DataFrame:
    """Values of the row with the greatest time, smallest tie key first, per group.

    An aggregate, not a window: partial maxima are merged before the shuffle, so a hot key
    costs one row per task instead of being sorted in one. Ties are settled in a second
    aggregation over the rows that share the greatest time.
    """
    newest = rows.groupBy(*keys).agg(
        F.max(time).alias("newest"),
        F.expr(f"max_by(struct({', '.join([tie, *values])}), struct({time}, {_reversed(tie)})) AS row"),
    )
    return newest.select(*keys, F.col("newest").alias(f"latest_{time}"), *[F.col(f"row.{v}").alias(v) for v in values])


def _reversed(text: str) -> str:
    """Order-reversing twin of a text key: larger exactly when the key is smaller.

    Every UTF-8 byte is written as the hex digits of its complement, and a closing mark
    ranks a prefix above its extensions.
    """
    return f"concat(translate(hex(encode({text}, 'UTF-8')), '0123456789ABCDEF', 'FEDCBA9876543210'), 'G')"
