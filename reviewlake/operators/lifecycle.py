"""Questions about a table of jobs: what is due, what is stuck, which result is current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import DEFAULT_LIMITS, Limits
from ..schemas import TERMINAL_STATUSES
from ..sources.folders import stored
from .skew import lookup_join, next_within

# Publication states that are swept, and the sweep size.
SWEPT_PUBLICATIONS = ("in_progress", "pending", "retry_pending", "enqueue_failed")
SWEEP_LIMIT = 100


def _past(deadline: str, now: Column) -> Column:
    """A missing deadline counts as past."""
    return F.col(deadline).isNull() | (F.col(deadline) <= now)


def claim_decision(jobs: DataFrame, now: Column, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``work_state`` as of ``now``: deferred, skipped, failed or claimed.

    The deadline is tested before the status, so a finished job with a future deadline
    is deferred. An expired lease is noted whatever is decided; only running out of attempts replaces it.
    """
    expired = (F.col("status") == "processing") & _past("lease_expires_at", now)
    waiting = (F.col("status") == "queued") | expired
    state = (F.when(F.col("next_attempt_at") > now, "deferred").when(~waiting, "skipped")
             .when(F.col("attempt_count") >= limits.max_attempts, "failed").otherwise("claimed"))
    return (jobs.withColumn("work_state", state).withColumn("lease_expired", expired)
            .withColumn("work_error", F.when(F.col("work_state") == "failed", "retry_limit_exceeded")
                        .when(expired, "worker_lease_expired")))


def due_reviews(jobs: DataFrame, now: Column, limit: int = SWEEP_LIMIT) -> DataFrame:
    """Oldest jobs to work on: queued and due, or processing with an expired lease."""
    due = (((F.col("status") == "queued") & _past("next_attempt_at", now))
           | ((F.col("status") == "processing") & _past("lease_expires_at", now)))
    return jobs.filter(F.col("installation_id").isNotNull() & due).orderBy("created_at", "id").limit(limit)


def due_publications(jobs: DataFrame, now: Column, limit: int = SWEEP_LIMIT) -> DataFrame:
    """Oldest finished jobs whose publication is open and due."""
    open_ = F.col("publication_status").isNull() | F.col("publication_status").isin(*SWEPT_PUBLICATIONS)
    due = F.col("status").isin(*TERMINAL_STATUSES) & open_ & _past("next_publication_at", now)
    return jobs.filter(F.col("installation_id").isNotNull() & due).orderBy("created_at", "id").limit(limit)


def fence(results: DataFrame, jobs: DataFrame, review: str = "review_id") -> DataFrame:
    """Results of the current attempt only: the lease token is the one the job holds now."""
    held = jobs.filter(F.col("lease_token").isNotNull()).select(review, "lease_token")
    return lookup_join(results, held, [review, "lease_token"], how="left_semi")


def latest_state(jobs: DataFrame, outcomes: DataFrame, review: str = "review_id") -> DataFrame:
    """Current state of each job from its outcome events (``ts``, ``seq``, ``status``, ``error``, ``deadline``).

    A job without an event keeps the status it was created with. Only a re-queued job has a
    deadline and only a finished one a completion time.
    """
    last = outcomes.groupBy(review).agg(
        F.max_by(F.struct("status", "error", "deadline", "ts"), F.struct("ts", "seq")).alias("_last"))
    joined = jobs.join(last, review, "left")
    status = F.coalesce(F.col("_last.status"), F.col("status"))
    return (joined.withColumn("current_status", status)
            .withColumn("error_code", F.col("_last.error"))
            .withColumn("next_attempt", F.when(F.col("_last.status") == "queued", F.col("_last.deadline")))
            .withColumn("completed", F.when(F.col("_last.status") != "queued", F.col("_last.ts")))
            .drop("_last"))


# Widths of the time blocks of a log in microseconds, coarse to fine, and the records one block should not pass.
BLOCK_WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000)
BLOCK_ROWS = 20_000


def time_blocks(log: DataFrame, stamp: Column, review: str = "review_id", most: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``, the start of a record's time block: a day, or less where a job's day holds too much.

    A block with more than ``most`` records is split into blocks of the next width, down to a thousandth
    of a second. Only the crowded blocks of each width are looked at again, so an ordinary log costs one
    count of its days.
    """
    at = lambda width: F.floor(stamp / width) * width
    marked = log.withColumn("_block", at(BLOCK_WIDTHS[0]))
    for finer in BLOCK_WIDTHS[1:]:
        crowded = stored(marked.groupBy(review, "_block").agg(F.count(F.lit(1)).alias("_rows"))
                         .filter(F.col("_rows") > most).select(review, "_block", F.lit(True).alias("_crowded")), "crowded")
        if crowded.isEmpty():
            break
        marked = (marked.join(crowded, [review, "_block"], "left")
                  .withColumn("_block", F.when(F.col("_crowded"), at(finer)).otherwise(F.col("_block"))).drop("_crowded"))
    return marked


def stage_timeline(log: DataFrame, review: str = "review_id", most: int = BLOCK_ROWS) -> DataFrame:
    """Add ``stage_seconds``, the time until the job's next log record (``ts``, ``seq``, ``stage``).

    A job with a huge log is cut into time blocks as fine as it needs; see :func:`next_within`.
    """
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    blocks = time_blocks(log, stamp, review, most)
    timed = next_within(blocks, [review], F.col("_block"), [F.col("ts"), F.col("seq")], stamp, "_next")
    return timed.withColumn("stage_seconds", (F.col("_next") - stamp) / F.lit(1_000_000.0)).drop("_next", "_block")


def stage_durations(log: DataFrame, review: str = "review_id", most: int = BLOCK_ROWS) -> DataFrame:
    """Records and micro-exact total seconds per stage over all jobs."""
    timed = stage_timeline(log, review, most)
    micros = F.round(F.col("stage_seconds") * 1_000_000).cast("bigint")
    return timed.groupBy("stage").agg(
        F.count(F.lit(1)).alias("records"), F.count("stage_seconds").alias("timed"),
        (F.coalesce(F.sum(micros), F.lit(0)) / F.lit(1_000_000.0)).alias("seconds"))


def component_seconds(log: DataFrame, review: str = "review_id") -> DataFrame:
    """Per job: seconds its last attempt spent on each component, null for one that did not end.

    The first analysis runs from ``started`` to ``static_completed``, the second from there to ``ai_completed``.
    Two aggregates of one row per job, no window.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    began = log.filter(F.col("stage") == "started").groupBy(review).agg(F.max(at).alias("_began"))
    ends = log.join(began, review).filter(at >= F.col("_began")).groupBy(review).agg(
        F.first("_began").alias("_began"), *[F.min(F.when(F.col("stage") == stage, at)).alias(name)
                                             for stage, name in (("static_completed", "_static"), ("ai_completed", "_ai"))])
    seconds = lambda a, b: (F.when(F.col(b) >= F.col(a), F.col(b) - F.col(a)) / F.lit(1_000_000.0))
    return ends.select(review, seconds("_began", "_static").alias("static_analysis_seconds"), seconds("_static", "_ai").alias("ai_analysis_seconds"))
