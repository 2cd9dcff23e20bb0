"""Load and provider statistics, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TERMINAL_STATUSES, TOKEN_COUNTERS
from ..sources.folders import stored
from .report import seconds_between

# Steps per factor of two in the coarse histogram of a percentile.
STEPS = 64
# Cells a bucket is cut into when too many values hit it, and the number of distinct values one task may order.
CELLS, SMALL = 1024, 20_000


def _bucket(value: Column) -> Column:
    """A step function that never falls: ``STEPS`` steps per factor of two at any size, bounded in number.

    1075 is the number of halvings from 1 to the least positive double.
    """
    size = F.when(value == 0, 0).otherwise(F.floor((F.log2(F.abs(value)) + 1075) * STEPS) + 1)
    return F.when(value < 0, -size).otherwise(size)


def _cell(value: Column, low: Column, high: Column) -> Column:
    """Place of a value among the equal cells between a bucket's least and largest value."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(0)


def _hits(members: DataFrame, by: Sequence[str], outer: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """The buckets that hold a wanted rank: where they start, what they hold, their least and largest value.

    ``members`` are distinct values ``_v`` with their number ``_c`` and bucket ``_b``; below the first
    level, also the bucket they were cut from, ``outer``, whose start and ranks are known.
    """
    sizes = members.groupBy(*by, *outer, "_b").agg(
        F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        *([F.first(c).alias(c) for c in ("_from", "n", *[f"_r_{name}" for name in ranks])] if outer else []))
    order = Window.partitionBy(*by, *outer).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("_from") if outer else F.lit(0).cast("bigint")
    placed = sizes.withColumn("_end", begin + F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
    if not outer:
        placed = placed.withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
        for name, rank in ranks.items():
            placed = placed.withColumn(f"_r_{name}", rank)
    wanted = F.lit(False)
    for name in ranks:
        wanted = wanted | _inside(name)
    return placed.filter(wanted).select(*by, *outer, "_b", "_start", "_distinct", "_low", "_high", "n", *[f"_r_{name}" for name in ranks])


def _inside(name: str) -> Column:
    return (F.col(f"_r_{name}") > F.col("_start")) & (F.col(f"_r_{name}") <= F.col("_end"))


def _narrowed(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The distinct values of the buckets that hold the wanted ranks, at most ``SMALL`` in each."""
    known = (df.filter(F.col(value).isNotNull())
             .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    members, outer = known.withColumn("_b", _bucket(F.col("_v")).cast("bigint")), []
    while True:
        hits = stored(_hits(members, by, outer, ranks), "ranks")  # one row per group and rank at most
        keys = [*by, *outer, "_b"]
        members = (members.select(*keys, "_v", "_c").join(hits, keys)
                   .withColumn("_b", F.concat_ws("/", *outer, F.col("_b").cast("string"))).drop(*outer))
        if (hits.agg(F.max("_distinct")).first()[0] or 0) <= SMALL:
            return members
        # Cut every hit bucket between its own least and largest value and look again.
        members = (members.withColumnsRenamed({"_b": "_outer", "_start": "_from"})
                   .withColumn("_b", _cell(F.col("_v"), F.col("_low"), F.col("_high")).cast("bigint")).drop("_distinct", "_low", "_high"))
        outer = ["_outer"]


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group: a column for each 1-based rank given in terms of ``n``.

    Equal values are counted together first, then a coarse histogram finds the buckets that hold the
    ranks. A bucket hit that holds more than ``SMALL`` distinct values is cut between its own least and
    largest value, again and again, so however close the values lie, no task orders more than that. A
    rank beyond the group, or a group without values, gives null.
    """
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = (_narrowed(df, by, value, ranks).withColumn("_end", F.col("_start") + F.sum("_c").over(within))
              .withColumn("_start", F.col("_end") - F.col("_c")))
    return values.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.max(F.when(_inside(name), F.col("_v"))).alias(name) for name in ranks])


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact nearest-rank percentiles, e.g. ``{"p95": 0.95}``, with the count ``n`` of values."""
    ranks = {name: F.greatest(F.ceil(F.col("n") * F.lit(float(p))), F.lit(1)) for name, p in percents.items()}
    return at_ranks(df, by, value, ranks)


def job_timings(jobs: DataFrame) -> DataFrame:
    """Add ``queue_wait_seconds`` and ``processing_seconds``, null where an end is missing."""
    return (jobs.withColumn("queue_wait_seconds", seconds_between("created_at", "started_at"))
            .withColumn("processing_seconds", seconds_between("started_at", "completed_at")))


def run_outcomes(jobs: DataFrame, expected: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a run against the number of jobs it should have made."""
    count = lambda condition: F.count(F.when(condition, 1))
    total = F.count(F.lit(1))
    return jobs.groupBy(*by).agg(
        count(F.col("status") == "completed").alias("completed"),
        count(F.col("status") == "failed").alias("failed"),
        count(~F.col("status").isin(*TERMINAL_STATUSES)).alias("unfinished"),
        F.greatest(F.lit(expected) - total, F.lit(0)).cast("bigint").alias("missing_jobs"),
        F.greatest(total - F.lit(expected), F.lit(0)).cast("bigint").alias("duplicate_jobs"),
        total.alias("logical_reviews"))


def status_histogram(df: DataFrame, column: str = "http_status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("requests"))


def throughput(jobs: DataFrame, start: str = "created_at", end: str = "completed_at",
               by: Sequence[str] = ()) -> DataFrame:
    """Completed jobs per minute of the run, which lasts from the first start to the last end."""
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    done = F.count(F.when(F.col("status") == "completed", 1))
    elapsed = (F.max(micros(end)) - F.min(micros(start))) / F.lit(1_000_000.0)
    return jobs.groupBy(*by).agg(
        done.alias("completed"), elapsed.alias("elapsed_seconds"),
        (F.try_divide(done.cast("double"), elapsed) * 60).alias("jobs_per_minute"))


def provider_stats(calls: DataFrame, by: Sequence[str] = (),
                   counters: Sequence[str] | None = None) -> DataFrame:
    """Failure rate, averaged median, nearest-rank p95 and mean tokens of provider calls.

    ``calls``: ``status``, ``seconds`` and the counters, by default those of the token counters that it has.
    A mean exists only when every successful call reports that counter.
    """
    counters = [c for c in TOKEN_COUNTERS if c in calls.columns] if counters is None else counters
    good = calls.filter(F.col("status") == "completed")
    ok = F.col("status") == "completed"
    totals = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count(F.when(ok, 1)).alias("completed"),
        *[F.when((F.count(F.when(ok, F.col(c))) == F.count(F.when(ok, 1))) & (F.count(F.when(ok, 1)) > 0),
                 F.avg(F.when(ok, F.col(c)))).alias(f"average_{c}") for c in counters])
    n = F.col("n")
    ranks = at_ranks(good, by, "seconds", {
        "_low": F.floor((n + 1) / 2), "_high": F.ceil((n + 1) / 2),
        "successful_p95_seconds": F.greatest(F.ceil(n * F.lit(0.95)), F.lit(1))})
    if by:
        joined = totals.join(ranks, list(by), "left")
    else:
        joined = totals.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return joined.select(
        *by, "attempted", "completed",
        (1 - F.col("completed") / F.col("attempted")).alias("failure_rate"),
        ((F.col("_low") + F.col("_high")) / 2).alias("successful_median_seconds"),
        "successful_p95_seconds", *[f"average_{c}" for c in counters])


def counts_by_source(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Static and model findings."""
    family = F.when(F.col("source") == "ai", "ai").otherwise("static")
    return findings.groupBy(*by, family.alias("family")).agg(F.count(F.lit(1)).alias("findings"))
