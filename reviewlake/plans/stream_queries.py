"""Streams replayed over the given tables; each equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..schemas import DELIVERY
from ..session import DEFAULTS
from ..sources.folders import shared_folder
from ..sources.manifest import Files
from ..sources.readers import read_deliveries
from ..streaming import streams as M
from .fixtures import oracle, view
from .ingest_queries import _CTES, _ID, SECRET, signed_rows
from .registry import query

PARTS = 3  # loads, and so micro-batches, an input is cut into
FILE_ROWS = 25_000  # rows of one file of a load, as many tasks read a load


def load_files(rows: DataFrame) -> int:
    """Files of each load of these rows; a micro-batch takes that many."""
    return max(1, -(-rows.count() // (PARTS * FILE_ROWS)))


def land(rows: DataFrame, path: str, files: int, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Append the rows, in the ``shape`` they land in, as exactly ``files`` files: one load, written and read by as many tasks."""
    count = lambda: sum(name.endswith(".parquet") for name in Files(rows.sparkSession, path).names(""))
    due = count() + files
    shaped = shape(rows.coalesce(1) if files == 1 else rows.repartition(files))
    shaped.write.mode("append").parquet(path)
    for _ in range(due - count()):  # a load too small for all its files; empty ones keep the micro-batches apart
        rows.sparkSession.createDataFrame([], shaped.schema).coalesce(1).write.mode("append").parquet(path)


def landed_files(spark: SparkSession, sf_dir: str, repeat: bool = True, closing_days: int = 0, ordered: bool = False) -> tuple[str, int]:
    """All deliveries as loads of the landing folder, without any order or in order of arrival; the first load lands twice.

    Also gives the number of files of a load. With ``closing_days`` a last file holds one refused delivery so much
    later: the end of the replay, which moves the watermark past everything before it.
    """
    landed = view(spark, sf_dir, "landed")
    deliveries = lambda rows: signed_rows(rows).withColumn("received_at", F.col("received_at").cast("timestamp")).select(*DELIVERY.fieldNames())
    path, files = shared_folder(spark, "landed"), load_files(landed)
    part = F.pmod(F.xxhash64("seq"), F.lit(PARTS))
    if ordered:
        last = landed.agg(F.max("seq")).first()[0] or 0
        part = F.floor(F.col("seq") * PARTS / (last + 1))
    for number in [*range(PARTS), *([0] if repeat else [])]:
        land(landed.filter(part == number), path, files, deliveries)
    if closing_days:
        end = deliveries(landed).agg(F.max("received_at").alias("received_at")).select(
            F.lit("end").alias("delivery_id"), F.lit("ping").alias("event_type"), F.lit("none").alias("signature"), F.lit(b"").alias("body"),
            (F.col("received_at") + F.make_dt_interval(F.lit(closing_days))).alias("received_at"), F.lit(-1).cast("bigint").alias("seq"))
        end.coalesce(1).write.mode("append").parquet(path)
    return path, files


def arrivals(spark: SparkSession, path: str, files: int) -> DataFrame:
    return M.stream_deliveries(spark, path, SECRET, files_per_batch=files)


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage log as a stream: loads by time, one per micro-batch, and a closing row a day after the last."""
    rows = view(spark, sf_dir, "stage_log").select("review_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "stage", "status", "value")
    path, files = shared_folder(spark, "log"), load_files(rows)
    span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if span.low is not None:
        step = (span.high - span.low) / PARTS
        part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span.low))) / max(1, int(step.total_seconds() * 1e6))), F.lit(PARTS - 1))
        for number in range(PARTS):
            land(rows.filter(part == number), path, files)
        end = spark.range(1).select(F.lit(-1).cast("bigint").alias("review_id"), (F.lit(span.high) + F.make_dt_interval(F.lit(1))).alias("ts"),
                                    F.lit(-1).cast("bigint").alias("seq"), F.lit("end").alias("stage"), F.lit("end").alias("status"), F.lit(0.0).alias("value"))
        end.coalesce(1).write.mode("append").parquet(path)
    else:
        rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(spark: SparkSession, stream: DataFrame, write=None, mode: str = "append", out: str | None = None) -> DataFrame | None:
    """Replay the stream; what it wrote, unless a sink of its own keeps it."""
    target = out or shared_folder(spark, "stream-out")
    M.replay(stream, target, shared_folder(spark, "stream-state"), write, mode)
    return None if write else spark.read.parquet(target)


@query("source_deliveries", "OP-S1", sql=oracle(
    "SELECT seq, delivery_id, event_type, octet_length(encode(body_text)) AS body_bytes, action, reason FROM judged", **_CTES))
def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = landed_files(spark, sf_dir, repeat=False)
    raw = read_deliveries(spark, path)
    checked = I.prepare(raw.withColumn("body_bytes", F.octet_length("body").cast("bigint")), SECRET)
    return checked.select("seq", "delivery_id", "event_type", "body_bytes", "action", I.rejection().alias("reason"))


@query("stream_ingest", "OP-M1", "OP-S1", sql=oracle("SELECT seq, delivery_id, action, reason FROM judged", **_CTES))
def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = arrivals(spark, *landed_files(spark, sf_dir, repeat=False))
    return _run(spark, stream.select("seq", "delivery_id", "action", I.rejection().alias("reason")))


@query("stream_dedup", "OP-M2", sql=oracle("SELECT delivery_id, seq, received_at, action, handled FROM firsts", **_CTES))
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = M.dedup_stream(arrivals(spark, *landed_files(spark, sf_dir, closing_days=130)), "60 days")
    return _run(spark, first.select("delivery_id", "seq", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "action", "handled"))


@query("stream_upsert_jobs", "OP-M3", sql=oracle(
    f"SELECT DISTINCT {_ID} AS review_id, repository_name, pull_request_number, head_sha FROM firsts WHERE handled", **_CTES))
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = shared_folder(spark, "jobs")
    # Which of two deliveries under one id counts is settled by their order; the sink keeps the one that came in first.
    passing = arrivals(spark, *landed_files(spark, sf_dir, ordered=True)).filter(I.rejection().isNull())
    _run(spark, passing, M.ingest_sink(shared_folder(spark, "deliveries"), jobs, buckets=8))
    return M.state_table(spark, jobs, "review_id").read().select("review_id", *I.JOB_KEY)


@query("stream_heads", "OP-M4", sql=oracle(
    """SELECT DISTINCT d.repository_name, d.pull_request_number, d.head_sha, h.current_head
       FROM (SELECT * FROM judged WHERE reason IS NULL AND handled) d
       JOIN (SELECT repository_name, pull_request_number, arg_max(head_sha, (received_at, seq)) AS current_head FROM judged
             WHERE reason IS NULL AND handled GROUP BY ALL) h
         ON h.repository_name = d.repository_name AND h.pull_request_number = d.pull_request_number AND h.current_head <> d.head_sha""", **_CTES))
def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, events = shared_folder(spark, "heads"), shared_folder(spark, "superseded")
    handled = arrivals(spark, *landed_files(spark, sf_dir)).filter(I.rejection().isNull() & F.col("handled"))
    _run(spark, handled, M.track_heads(heads, events, buckets=8))
    # An event names the head that was current then; the state says which one is now.
    state = M.state_table(spark, heads, M.PULL_REQUEST).read()
    current = state.groupBy(*M.PULL_REQUEST).agg(F.max_by("head_sha", "at").alias("current_head"))
    replaced = spark.read.parquet(events).select(*M.PULL_REQUEST, "head_sha").distinct()
    return replaced.join(current, list(M.PULL_REQUEST)).filter("head_sha <> current_head").select(*M.PULL_REQUEST, "head_sha", "current_head")


@query("stream_per_minute", "OP-M6", sql=oracle(
    """SELECT date_trunc('minute', ts) AS minute, count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed,
         max(value) AS max_wait_seconds, true AS p95_within_bound FROM stage_log GROUP BY 1"""))
def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_stream(spark, sf_dir).select("ts", "status", F.col("value").alias("wait_seconds"))
    minutes = _run(spark, M.per_minute(rows, "0 seconds")).drop("wait_sketch")
    # The share of a minute's exact values below and up to the sketch's answer must enclose 95 %, but for its bound.
    waits = view(spark, sf_dir, "stage_log").select(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"), "value")
    answer, n = F.col("approx_p95_wait_seconds"), F.col("jobs")
    ranks = waits.join(minutes, "minute").groupBy("minute").agg(
        F.count(F.when(F.col("value") < answer, 1)).alias("below"), F.count(F.when(F.col("value") <= answer, 1)).alias("upto"))
    slack = F.when(n <= M.SKETCH_SIZE, 0).otherwise(F.ceil(n * M.RANK_ERROR)) + 1  # one rank, for how a share of n is rounded
    checked = minutes.join(ranks, "minute").withColumn("p95_within_bound", (F.col("below") <= 0.95 * n + slack) & (F.col("upto") >= 0.95 * n - slack))
    return checked.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "jobs", "completed", "max_wait_seconds", "p95_within_bound")


@query("stream_status_view", "OP-M7", sql=oracle("SELECT status, count(*) AS reviews FROM stage_log GROUP BY status"))
def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, M.status_view(log_stream(spark, sf_dir)), mode="complete")


TASK_LIMIT = 1830  # a task may take half an hour; 30 seconds are granted on top
_OVERDUE = f"""SELECT review_id, ts AS started_at, ts + INTERVAL '{TASK_LIMIT}' SECOND AS overdue_at FROM (
    SELECT *, lead(ts) OVER (PARTITION BY review_id ORDER BY ts, seq) AS following FROM stage_log)
    WHERE stage = 'started' AND (following IS NULL OR following > ts + INTERVAL '{TASK_LIMIT}' SECOND)"""


def _starts(log: DataFrame) -> DataFrame:
    return log.select("review_id", F.col("ts").cast("timestamp").alias("ts"), "seq", (F.col("stage") == "started").alias("started"))


def _naive(rows: DataFrame) -> DataFrame:
    return rows.select("review_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "overdue_at")])


@query("job_overdue", "OP-M5", sql=oracle(_OVERDUE))
def _overdue_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(M.overdue_batch(_starts(view(spark, sf_dir, "stage_log")), TASK_LIMIT))


@query("stream_overdue", "OP-M5", sql=oracle(_OVERDUE))
def _overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A load's groups are many: the state store that keeps them off the heap. The setting is read when a stream starts.
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, DEFAULTS[key])
    try:
        rows = _starts(log_stream(spark, sf_dir))
        return _naive(_run(spark, M.overdue_stream(rows, TASK_LIMIT, "1 hour")))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
