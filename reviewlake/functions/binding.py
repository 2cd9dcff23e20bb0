"""Evaluate a column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst may inline a projected expression into each place that reads it, also
    into a lambda that runs per array element. A lambda argument is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed here and nowhere else.

    A filter above a projection is rewritten in terms of the projected expressions, and so
    are the constraints derived from it; a costly column that several conditions read is
    then copied many times over. The output of a generator is left alone, so the columns
    are passed through one that yields exactly one row.
    """
    kept = [name for name in df.columns if name not in columns]
    pinned = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))).alias("_pinned")
    return df.select(*kept, pinned).select(*kept, *[F.col(f"_pinned.{name}").alias(name) for name in columns])
