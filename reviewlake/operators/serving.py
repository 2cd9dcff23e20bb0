"""The queries behind the pages of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import JOB_STATUSES
from .report import seconds_between
from .skew import lookup_join
from .stats import at_ranks

MAX_PAGE = 100
# Rows before a page that may still be found by a top-k; deeper pages are found by rank.
SHALLOW = 10_000
REPORTED_STATUSES = ("completed", "failed")


def list_reviews(jobs: DataFrame, page: int = 1, size: int = 20, totals: DataFrame | None = None) -> DataFrame:
    """A page of jobs, newest first, with ``finding_count`` when ``totals`` (id, total_findings) is given.

    The page is cut first, as a top-k, and only its rows are looked up. A page behind the first ``SHALLOW``
    rows does not carry them all to one task: the creation time its first row has is an order statistic,
    and the page is a top-k from there on.
    """
    if page < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page must be >= 1 and size within 1..100")
    skipped = (page - 1) * size
    if skipped > SHALLOW:
        jobs, skipped = _from_rank(jobs, skipped)
    rows = jobs.orderBy(F.desc("created_at"), F.desc("id")).offset(skipped).limit(size)
    return rows if totals is None else with_counts(rows, totals)


def _from_rank(jobs: DataFrame, skipped: int) -> tuple[DataFrame, int]:
    """The jobs from the creation time of the row behind ``skipped`` ones on, and how many of them still come before it."""
    age = -F.unix_micros(F.col("created_at").cast("timestamp"))
    for key, value in (("created_at", age), ("id", -F.col("id"))):
        found = at_ranks(jobs.select(value.alias("_key")), [], "_key", {"edge": F.lit(skipped + 1)}).first()
        if found is None or found["edge"] is None:
            return jobs.limit(0), 0
        edge = int(found["edge"])
        newer = jobs.filter(value < edge).count()
        tied = jobs.filter(value == edge)
        if key == "id" or skipped - newer <= SHALLOW:
            return jobs.filter(value >= edge), skipped - newer
        # More rows share the creation time than a top-k should carry: the id decides among them.
        if tied.count() <= skipped - newer + MAX_PAGE:
            return jobs.filter(value >= edge), skipped - newer
        jobs, skipped = tied, skipped - newer
    return jobs, skipped


def list_reviews_after(jobs: DataFrame, created_at: Column, last_id: Column, size: int = 20) -> DataFrame:
    """The page behind a known last row; its cost does not grow with the page number."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError("size must be within 1..100")
    older = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") < last_id))
    return jobs.filter(older).orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def with_counts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Add ``finding_count``; null when there is no report, zero when the report is empty."""
    counts = totals.select("id", F.col("total_findings").alias("_total"))
    count = F.when(F.col("has_report") == 1, F.coalesce("_total", F.lit(0)))
    return rows.join(counts, "id", "left").withColumn("finding_count", count).drop("_total")


def count_reviews(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"))


def status_summary(jobs: DataFrame) -> DataFrame:
    """Total and zero-filled count per status, in one row."""
    known = F.col("status").isNotNull()
    return jobs.agg(F.count(F.when(known, 1)).alias("total_reviews"),
                    *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in JOB_STATUSES])


def report_availability(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """For each asked id: ``not_found``, ``not_available`` or ``available``."""
    known = jobs.select("id", F.col("status").alias("_status"), F.col("has_report").alias("_has"))
    answer = (F.when(F.col("_status").isNull(), "not_found")
              .when((F.col("_has") == 1) & F.col("_status").isin(*REPORTED_STATUSES), "available")
              .otherwise("not_available"))
    return ids.join(known, "id", "left").withColumn("availability", answer).drop("_status", "_has")


def findings_of(findings: DataFrame, ids: DataFrame, review: str = "review_id") -> DataFrame:
    """Findings of the asked jobs, in (path, line, source, category) order within a job."""
    asked = ids.select(F.col(ids.columns[0]).alias(review))
    return lookup_join(findings, asked, [review], how="left_semi").orderBy(
        review, "file_path", "line_number", "source", "category", "idx")


def review_duration(jobs: DataFrame) -> DataFrame:
    """Add ``duration_seconds``: never negative, null unless both ends are set."""
    elapsed = seconds_between("started_at", "completed_at")
    return jobs.withColumn("duration_seconds", F.when(elapsed.isNotNull(), F.greatest(elapsed, F.lit(0.0))))
