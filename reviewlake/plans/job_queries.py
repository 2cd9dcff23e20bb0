"""Job history, serving and load statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import backoff_seconds, safe_error
from ..operators import lifecycle as H
from ..operators import serving as J
from ..operators import report as R
from ..operators import stats as L
from ..operators.skew import lookup_join
from ..schemas import TOKEN_COUNTERS
from ..sources.writers import stage_log
from .fixtures import oracle, view
from .registry import query
from .report_queries import _RAW, NOW, NOW_NTZ, merged_rows


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "review_jobs")


_EXPIRED = f"(status = 'processing' AND (lease_expires_at IS NULL OR lease_expires_at <= {NOW}))"


@query("job_claim_decision", "OP-H1", sql=oracle(
    f"""SELECT id, work_state, CASE WHEN work_state = 'failed' THEN 'retry_limit_exceeded' WHEN expired
          THEN 'worker_lease_expired' END AS work_error
        FROM (SELECT id, {_EXPIRED} AS expired, CASE WHEN next_attempt_at > {NOW} THEN 'deferred' WHEN NOT (status = 'queued' OR {_EXPIRED}) THEN 'skipped'
                WHEN attempt_count >= 4 THEN 'failed' ELSE 'claimed' END AS work_state FROM review_jobs)"""))
def _claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.claim_decision(jobs(spark, sf_dir), F.expr(NOW_NTZ)).select("id", "work_state", "work_error")


@query("job_due_reviews", "OP-H2", sql=oracle(
    f"""SELECT id, created_at, status FROM review_jobs WHERE installation_id IS NOT NULL AND ((status = 'queued' AND (next_attempt_at IS NULL
          OR next_attempt_at <= {NOW})) OR {_EXPIRED}) ORDER BY created_at, id LIMIT 100"""))
def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.due_reviews(jobs(spark, sf_dir), F.expr(NOW_NTZ)).select("id", "created_at", "status")


@query("job_due_publications", "OP-H3", sql=oracle(
    f"""SELECT id, created_at, publication_status FROM review_jobs WHERE installation_id IS NOT NULL AND status IN ('completed', 'failed', 'superseded')
          AND (publication_status IS NULL OR publication_status IN ('in_progress', 'pending', 'retry_pending', 'enqueue_failed'))
          AND (next_publication_at IS NULL OR next_publication_at <= {NOW}) ORDER BY created_at, id LIMIT 100"""))
def _due_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.due_publications(jobs(spark, sf_dir), F.expr(NOW_NTZ)).select("id", "created_at", "publication_status")


@query("job_backoff", "OP-H4", sql=oracle(
    """SELECT id, CAST(greatest(30 * 2 ** attempt_count, coalesce(CASE WHEN id % 3 = 0 THEN id % 400 END, 0)) AS BIGINT) AS delay FROM review_jobs"""))
def _backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("id") % 3 == 0, F.col("id") % 400)
    return jobs(spark, sf_dir).select("id", backoff_seconds(F.col("attempt_count") + 1, asked).alias("delay"))


@query("job_fence", "OP-H5", sql=oracle(
    """SELECT review_id, idx FROM raw_findings f JOIN review_jobs j ON j.id = f.review_id
       WHERE md5('lease' || CAST(f.review_id + CASE WHEN f.idx % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR)) = j.lease_token"""))
def _fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every third result was computed under a lease that has passed on since.
    stale = F.when(F.col("idx") % 3 == 2, 1).otherwise(0)
    results = view(spark, sf_dir, "raw_findings").select("review_id", "idx", F.md5(
        F.concat(F.lit("lease"), (F.col("review_id") + stale).cast("string"))).alias("lease_token"))
    held = jobs(spark, sf_dir).select(F.col("id").alias("review_id"), "lease_token")
    return H.fence(results, held).select("review_id", "idx")


_SAFE = """CASE WHEN error IN ('ai_http_503', 'analyzer_timeout') THEN error ELSE 'processing_error' END"""


@query("job_safe_error", "OP-H6", sql=oracle(f"SELECT seq, CASE WHEN error IS NOT NULL THEN {_SAFE} END AS error FROM stage_log"))
def _safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "stage_log")
    return log.select("seq", F.when(F.col("error").isNotNull(), safe_error(F.col("error"))).alias("error"))


@query("job_latest_state", "OP-H7", sql=oracle(
    """SELECT j.id AS review_id, coalesce(l.status, j.status) AS current_status, l.error AS error_code,
         CASE WHEN l.status = 'queued' THEN l.deadline END AS next_attempt, CASE WHEN l.status <> 'queued' THEN l.ts END AS completed
       FROM review_jobs j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, seq DESC) AS rn FROM stage_log) l
         ON l.review_id = j.id AND l.rn = 1"""))
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs(spark, sf_dir).select(F.col("id").alias("review_id"), "status")
    return H.latest_state(table, view(spark, sf_dir, "stage_log")).select(
        "review_id", "current_status", "error_code", "next_attempt", "completed")


_NEXT = """SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY review_id ORDER BY ts, seq)) - epoch_us(ts)) AS micros FROM stage_log"""


@query("job_stage_timeline", "OP-H8", sql=oracle(
    "SELECT review_id, seq, stage, micros / 1000000.0::DOUBLE AS stage_seconds FROM timed", timed=_NEXT))
def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stage_timeline(view(spark, sf_dir, "stage_log")).select("review_id", "seq", "stage", "stage_seconds")


@query("job_stage_durations", "OP-H8", headline=True, sql=oracle(
    """SELECT stage, count(*) AS records, count(micros) AS timed, CAST(coalesce(sum(micros), 0) AS BIGINT) / 1000000.0::DOUBLE AS seconds
       FROM timed GROUP BY stage""", timed=_NEXT))
def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stage_durations(view(spark, sf_dir, "stage_log"))


@query("job_stage_log", "OP-S9", sql=oracle(
    f"""SELECT j.id AS review_id, j.repository_name AS repository, j.pull_request_number AS pull_request, j.head_sha, 'node-1' AS worker, l.stage,
          l.value AS duration, CASE WHEN l.error IS NOT NULL THEN {_SAFE} END AS error FROM stage_log l JOIN review_jobs j ON j.id = l.review_id"""))
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs(spark, sf_dir).select(F.col("id").alias("review_id"), "repository_name", "pull_request_number", "head_sha")
    events = view(spark, sf_dir, "stage_log").select(
        "review_id", "stage", F.col("value").alias("duration"), "error", F.lit("node-1").alias("worker"), "seq")
    return stage_log(lookup_join(events, table, ["review_id"], how="inner"))


# --- serving ------------------------------------------------------------------------------------

_TOTALS = "SELECT review_id AS id, count(*) AS total FROM merged GROUP BY review_id"


@query("serve_list_reviews", "OP-J1", "OP-J2", headline=True, sql=oracle(
    """SELECT p.id, p.created_at, p.status, CASE WHEN p.has_report = 1 THEN CAST(coalesce(t.total, 0) AS BIGINT) END AS finding_count
       FROM (SELECT * FROM review_jobs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100) p LEFT JOIN totals t ON t.id = p.id""",
    **_RAW, totals=_TOTALS))
def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The page is cut first; only its reviews are merged and counted.
    page = J.list_reviews(jobs(spark, sf_dir), page=3, size=50)
    totals = R.severity_summary(merged_rows(spark, sf_dir)).withColumnRenamed("review_id", "id")
    return J.with_counts(page, totals).select("id", "created_at", "status", "finding_count")


@query("serve_deep_page", "OP-J1", sql=oracle(
    """SELECT id, created_at, status FROM review_jobs ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 12000"""))
def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_reviews(jobs(spark, sf_dir), page=121, size=100).select("id", "created_at", "status")


@query("serve_list_after", "OP-J1", sql=oracle(
    f"""SELECT id, created_at, status FROM review_jobs WHERE created_at < {NOW} OR (created_at = {NOW} AND id < 500)
        ORDER BY created_at DESC, id DESC LIMIT 100"""))
def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_reviews_after(jobs(spark, sf_dir), F.expr(NOW_NTZ), F.lit(500), 100).select("id", "created_at", "status")


@query("serve_finding_counts", "OP-J2", sql=oracle(
    """SELECT j.id, CASE WHEN j.has_report = 1 THEN CAST(coalesce(t.total, 0) AS BIGINT) END AS finding_count
       FROM review_jobs j LEFT JOIN totals t ON t.id = j.id""", **_RAW, totals=_TOTALS))
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = R.severity_summary(merged_rows(spark, sf_dir)).withColumnRenamed("review_id", "id")
    return J.with_counts(jobs(spark, sf_dir), totals).select("id", "finding_count")


@query("serve_count_reviews", "OP-J1", sql=oracle("SELECT count(*) AS total FROM review_jobs"))
def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.count_reviews(jobs(spark, sf_dir))


@query("serve_status_summary", "OP-J3", sql=oracle(
    "SELECT count(status) AS total_reviews, " + ", ".join(
        f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in J.JOB_STATUSES) + " FROM review_jobs"))
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_summary(jobs(spark, sf_dir))


@query("serve_report_availability", "OP-J4", sql=oracle(
    """SELECT i.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.has_report = 1 AND j.status IN ('completed', 'failed') THEN 'available'
         ELSE 'not_available' END AS availability
       FROM (SELECT DISTINCT user_id * 20 AS id FROM events) i LEFT JOIN review_jobs j ON j.id = i.id"""))
def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "events").select((F.col("user_id") * 20).alias("id")).distinct()
    return J.report_availability(jobs(spark, sf_dir), ids)


@query("serve_findings_of", "OP-J5", sql=oracle(
    """SELECT review_id, file_path, line_number, source, category, idx FROM raw_findings WHERE review_id IN (SELECT id FROM review_jobs WHERE status = 'failed')
       ORDER BY review_id, file_path, line_number, source, category, idx"""))
def _findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = jobs(spark, sf_dir).filter("status = 'failed'").select("id")
    return J.findings_of(view(spark, sf_dir, "raw_findings"), ids).select(
        "review_id", "file_path", "line_number", "source", "category", "idx")


@query("serve_review_duration", "OP-J6", sql=oracle(
    """SELECT id, CASE WHEN started_at IS NOT NULL AND completed_at IS NOT NULL
         THEN greatest((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE, 0.0::DOUBLE) END AS duration_seconds FROM review_jobs"""))
def _duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.review_duration(jobs(spark, sf_dir)).select("id", "duration_seconds")


# --- load statistics -----------------------------------------------------------------------------

_TIMED = """SELECT id, repository_name, status, created_at, completed_at, (epoch_us(started_at) - epoch_us(created_at)) / 1000000.0::DOUBLE AS queue_wait_seconds,
    (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS processing_seconds FROM review_jobs"""


def _rank_sql(value: str, by: str, source: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT *, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL"


@query("stats_nearest_rank", "OP-L1", headline=True, sql=oracle(
    """SELECT repository_name, max(n) AS n, max(CASE WHEN rn = greatest(ceil(n * 0.5::DOUBLE), 1) THEN queue_wait_seconds END) AS p50,
         max(CASE WHEN rn = greatest(ceil(n * 0.95::DOUBLE), 1) THEN queue_wait_seconds END) AS p95 FROM ranked GROUP BY repository_name""",
    timed=_TIMED, ranked=_rank_sql("queue_wait_seconds", "repository_name", "timed")))
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = L.job_timings(jobs(spark, sf_dir))
    return L.nearest_rank(timed, "queue_wait_seconds", {"p50": 0.5, "p95": 0.95}, ["repository_name"])


@query("stats_nearest_rank_overall", "OP-L1", sql=oracle(
    """SELECT max(n) AS n, max(CASE WHEN rn = greatest(ceil(n * 0.5::DOUBLE), 1) THEN value END) AS p50,
         max(CASE WHEN rn = greatest(ceil(n * 0.99::DOUBLE), 1) THEN value END) AS p99 FROM ranked""", ranked=_rank_sql("value", "", "events")))
def _overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_rank(view(spark, sf_dir, "events"), "value", {"p50": 0.5, "p99": 0.99})


@query("stats_nearest_rank_epoch", "OP-L1", sql=oracle(
    """SELECT max(n) AS n, max(CASE WHEN rn = greatest(ceil(n * 0.5::DOUBLE), 1) THEN micros END) AS p50,
         max(CASE WHEN rn = greatest(ceil(n * 0.99::DOUBLE), 1) THEN micros END) AS p99 FROM ranked""",
    stamps="SELECT CAST(epoch_us(ts) AS DOUBLE) AS micros FROM events", ranked=_rank_sql("micros", "", "stamps")))
def _epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Large values close together: all of them lie in one bucket of the first histogram.
    stamps = view(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return L.nearest_rank(stamps, "micros", {"p50": 0.5, "p99": 0.99})


@query("stats_job_timings", "OP-L2", sql=oracle("SELECT id, queue_wait_seconds, processing_seconds FROM timed", timed=_TIMED))
def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.job_timings(jobs(spark, sf_dir)).select("id", "queue_wait_seconds", "processing_seconds")


@query("stats_run_outcomes", "OP-L3", sql=oracle(
    """SELECT repository_name, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
         count(*) FILTER (WHERE status IN ('queued', 'processing')) AS unfinished, greatest(250 - count(*), 0) AS missing_jobs,
         greatest(count(*) - 250, 0) AS duplicate_jobs, count(*) AS logical_reviews FROM review_jobs GROUP BY repository_name"""))
def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_outcomes(jobs(spark, sf_dir), 250, ["repository_name"])


@query("stats_status_histogram", "OP-L4", sql=oracle(
    "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS http_status, count(*) AS requests FROM events GROUP BY 1"))
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("http_status"))
    return L.status_histogram(events)


@query("stats_throughput", "OP-L5", sql=oracle(
    """SELECT repository_name, count(*) FILTER (WHERE status = 'completed') AS completed,
         (max(epoch_us(completed_at)) - min(epoch_us(created_at))) / 1000000.0::DOUBLE AS elapsed_seconds,
         count(*) FILTER (WHERE status = 'completed')::DOUBLE / nullif((max(epoch_us(completed_at)) - min(epoch_us(created_at))) / 1000000.0::DOUBLE, 0) * 60 AS jobs_per_minute
       FROM review_jobs GROUP BY repository_name"""))
def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.throughput(jobs(spark, sf_dir), by=["repository_name"])


_PROVIDER = """SELECT review_id % 40 AS run, CASE WHEN finish_reason = 'STOP' THEN 'completed' ELSE 'failed' END AS status,
    CAST(prompt_tokens AS DOUBLE) / 7 AS seconds, prompt_tokens, candidate_tokens, thought_tokens, total_tokens FROM model_responses"""
_AVERAGES = ", ".join(f"""CASE WHEN count({c}) FILTER (WHERE status = 'completed') = count(*) FILTER (WHERE status = 'completed')
    THEN avg({c}) FILTER (WHERE status = 'completed') END AS average_{c}""" for c in TOKEN_COUNTERS)


@query("stats_provider", "OP-L6", sql=oracle(
    f"""SELECT a.*, m.median AS successful_median_seconds, m.p95 AS successful_p95_seconds
       FROM (SELECT run, count(*) AS attempted, count(*) FILTER (WHERE status = 'completed') AS completed,
               1 - count(*) FILTER (WHERE status = 'completed') / count(*) AS failure_rate, {_AVERAGES} FROM calls GROUP BY run) a
       LEFT JOIN (SELECT run, median(seconds) AS median, max(CASE WHEN rn = greatest(ceil(n * 0.95::DOUBLE), 1) THEN seconds END) AS p95
                  FROM ranked GROUP BY run) m ON m.run = a.run""",
    calls=_PROVIDER, good="SELECT * FROM calls WHERE status = 'completed'", ranked=_rank_sql("seconds", "run", "good")))
def _provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "model_responses").select(
        (F.col("review_id") % 40).alias("run"), F.when(F.col("finish_reason") == "STOP", "completed").otherwise("failed").alias("status"),
        (F.col("prompt_tokens").cast("double") / 7).alias("seconds"), *TOKEN_COUNTERS)
    return L.provider_stats(calls, ["run"])


@query("stats_counts_by_source", "OP-L7", sql=oracle(
    "SELECT CASE WHEN source = 'ai' THEN 'ai' ELSE 'static' END AS family, count(*) AS findings FROM raw_findings GROUP BY 1"))
def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by_source(view(spark, sf_dir, "raw_findings"))
