"""Joins and orderings that stay balanced when one key holds a large share of the rows.

Nothing here collects a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many fact rows to a lookup with a few rows per key; ``how`` is inner, left, left_semi or left_anti.

    A plain equality join, so that the engine can broadcast a small lookup by its measured size or else
    split a hot key's fact rows, equal ones too, over tasks at run time (the session forces skew joins even where
    that costs a shuffle). The facts are read once and moved at most once.
    """
    return facts.join(lookup, list(on), how)


def number_within(df: DataFrame, group: Sequence[str], coarse: Column, order: Sequence[Column],
                  name: str = "rn") -> DataFrame:
    """Add the 1-based row number within ``group`` without bringing a group into one task.

    ``coarse`` must rise with ``order``: rows are counted per (group, coarse), the counts
    are summed up in coarse order, and only the rows of one coarse value are sorted
    together. The same numbers as ``row_number() over (group order by order)``.
    """
    marked = df.withColumn("_coarse", coarse)
    blocks = marked.groupBy(*group, "_coarse").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*group, "_coarse", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*group, "_coarse").orderBy(*order))
    return (marked.withColumn("_local", local).join(starts, [*group, "_coarse"])
            .withColumn(name, F.col("_start") + F.col("_local")).drop("_coarse", "_local", "_start"))


def number_whole(df: DataFrame, group: Sequence[str], coarse: Column, order: Sequence[Column],
                 name: str = "rn") -> DataFrame:
    """What :func:`number_within` adds, for groups that are small enough to be sorted each by one task.

    Rows that are partitioned by some of ``group`` already stay where they are.
    """
    placed = reduce(and_, [F.col(key).isNotNull() for key in group], coarse.isNotNull())
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).filter(placed)


def next_within(df: DataFrame, group: Sequence[str], coarse: Column, order: Sequence[Column],
                value: Column, name: str) -> DataFrame:
    """Add ``value`` of the next row of the group, like ``lead``, in two levels.

    Inside one coarse block a window finds the next row; the last row of a block takes the
    first value of the following block, found over one row per block.
    """
    marked = df.withColumn("_coarse", coarse).withColumn("_value", value)
    firsts = marked.groupBy(*group, "_coarse").agg(F.min_by("_value", F.struct(*order)).alias("_first"))
    over_blocks = Window.partitionBy(*group).orderBy("_coarse")
    following = firsts.select(*group, "_coarse", F.lead("_first").over(over_blocks).alias("_following"))
    local = Window.partitionBy(*group, "_coarse").orderBy(*order)
    return (marked.withColumn("_near", F.lead("_value").over(local))
            .join(following, [*group, "_coarse"])
            .withColumn(name, F.coalesce("_near", "_following"))
            .drop("_coarse", "_value", "_near", "_following"))
