"""Arrivals as streams.

Each stream computes what its batch operator computes when the whole input is replayed.
State is bounded by watermarks, or kept in tables that micro-batches join with.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let
from ..operators import ingest as I
from ..operators.skew import next_within
from ..schemas import JOB_STATUSES
from ..sources.readers import read_deliveries
from ..sources.manifest import BucketTable

Batch = Callable[[DataFrame, int], None]


def stream_deliveries(spark: SparkSession, path: str, secret: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Landed deliveries with all stateless checks; the same columns as in batch."""
    return I.prepare(read_deliveries(spark, path, streaming=True, fmt=fmt, files_per_batch=files_per_batch), secret)


def dedup_stream(deliveries: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrivals, by (received_at, seq) and not by who came in first; exact for repeats within ``delay``.

    The state of a delivery id is the least arrival so far; it is given out once the watermark says that
    no earlier one can come, ``delay`` after the last repeat. Older repeats are caught by
    :func:`upsert_by_key` in the sink.
    """
    rest = [c for c in deliveries.columns if c != "delivery_id"]
    # Refused arrivals move the watermark too; a condition that reads the time stays behind it.
    passing = F.when(F.col("received_at").isNotNull(), I.rejection().isNull())
    timed = deliveries.withWatermark("received_at", delay).filter(passing)
    kept = timed.groupBy("delivery_id", F.session_window("received_at", delay)).agg(
        F.min_by(F.struct(*rest), F.struct("received_at", "seq")).alias("_first"))
    return kept.select("delivery_id", "_first.*").select(*deliveries.columns)


# Buckets of a state table; a micro-batch reads those its keys fall into.
STATE_BUCKETS = 64


def state_table(spark: SparkSession, path: str, key: str | Sequence[str], buckets: int | None = None) -> BucketTable:
    """The table a sink of this module keeps at ``path``; ``read()`` gives its rows."""
    return BucketTable(spark, path, [key] if isinstance(key, str) else key, buckets)


def _applied(table: BucketTable, run: str, batch_id: int) -> bool:
    """Was this micro-batch committed before? Their numbers rise."""
    return table.state["done"].get(run, {"batch": -1})["batch"] >= batch_id


def _append(table: BucketTable, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], touched: list[int], run: str, batch_id: int) -> None:
    """Add a micro-batch's rows; touched buckets with too many folders are merged into one in the same commit."""
    crowded = table.crowded(touched)
    merged = table.write(merge(table.read(crowded)), "merged") if crowded else []
    added = table.write(rows, f"{run}-{batch_id}")
    table.commit([*merged, *added], crowded, rows.schema, **{run: {"batch": batch_id, "folders": [folder for _, folder in added]}})


def upsert_by_key(path: str, key: str, order: tuple[str, ...], run: str = "main", buckets: int = STATE_BUCKETS) -> Batch:
    """``foreachBatch`` function: append the rows whose key is new, the first row of each key.

    The table is bucketed by key. A micro-batch reads only the buckets its keys fall into, writes its new
    rows beside them and commits by manifest, so what it reads does not grow with the number of batches
    before it. A batch that is repeated, after a crash at any point, was either committed, and adds
    nothing, or never seen.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = state_table(batch.sparkSession, path, key, buckets)
        if _applied(table, run, batch_id):
            return
        first = I.first_arrivals(batch, key, order).persist()
        try:
            touched = table.touched(first)
            known = table.read(touched)
            fresh = first if known is None else first.join(known.select(key), key, "left_anti")
            _append(table, fresh, lambda rows: rows, touched, run, batch_id)
        finally:
            first.unpersist()
    return write


def added_by(spark: SparkSession, path: str, key: str, run: str, batch_id: int) -> DataFrame | None:
    """The rows that a run's last micro-batch added, from its own folders; None if it is not the last one."""
    table = state_table(spark, path, key)
    last = table.state["done"].get(run)
    if last is None or last["batch"] != batch_id or not last["folders"]:
        return None
    return spark.read.schema(T.StructType.fromJson(table.state["schema"])).parquet(*[f"{table.files.root}/{f}" for f in last["folders"]])


def upsert_jobs(path: str, run: str = "main", buckets: int = STATE_BUCKETS) -> Batch:
    """Jobs from handled deliveries, keyed by the hash id."""
    upsert = upsert_by_key(path, "review_id", ("created_at", "created_by"), run, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        jobs, _ = I.deliveries_to_jobs(batch)
        upsert(jobs, batch_id)
    return write


def ingest_sink(deliveries_path: str, jobs_path: str, run: str = "main", buckets: int = STATE_BUCKETS) -> Batch:
    """Deliveries and their jobs from passing arrivals.

    A delivery id is taken for good by its first arrival, however late a repeat comes; only
    the rows a micro-batch added to the delivery table make jobs.
    """
    keep = upsert_by_key(deliveries_path, "delivery_id", ("received_at", "seq"), run, buckets)
    make = upsert_jobs(jobs_path, run, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        added = added_by(batch.sparkSession, deliveries_path, "delivery_id", run, batch_id)
        if added is not None:
            make(added, batch_id)
    return write


PULL_REQUEST = ("repository_name", "pull_request_number")


def track_heads(heads_path: str, events_path: str, run: str = "main", buckets: int = STATE_BUCKETS) -> Batch:
    """Current head per pull request, and one event per head that a newer one replaced.

    A micro-batch is reduced to one row per head before anything is compared, so a pull request with a
    third of the arrivals costs no more than its distinct heads. Heads are state in buckets, of which a
    micro-batch reads the touched ones; merging a bucket keeps the newest head of each pull request. The
    events are written first, into the batch's own folder, and the state after them, so a batch that died
    in between is compared again with the state it first met.
    """
    newest_of = lambda rows: rows.groupBy(*PULL_REQUEST).agg(F.max_by("head_sha", "at").alias("head_sha"), F.max("at").alias("at"))

    def write(batch: DataFrame, batch_id: int) -> None:
        table = state_table(batch.sparkSession, heads_path, PULL_REQUEST, buckets)
        if _applied(table, run, batch_id):
            return
        seen = batch.groupBy(*PULL_REQUEST, "head_sha").agg(F.max(F.struct("received_at", "seq")).alias("at")).persist()
        try:
            newest = newest_of(seen)
            touched = table.touched(newest)
            known = table.read(touched)
            candidates = seen
            if known is not None:
                before = newest_of(known).join(newest.select(*PULL_REQUEST), list(PULL_REQUEST), "left_semi")
                candidates = seen.unionByName(before.select(*seen.columns))
            current = candidates.groupBy(*PULL_REQUEST).agg(F.max_by("head_sha", "at").alias("current_head"))
            replaced = (candidates.select(*PULL_REQUEST, "head_sha").distinct().join(current, list(PULL_REQUEST))
                        .filter(F.col("head_sha") != F.col("current_head")))
            (replaced.withColumn("batch", F.lit(f"{run}-{batch_id}")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(events_path))
            _append(table, newest.select("head_sha", "at", *PULL_REQUEST), newest_of, touched, run, batch_id)
        finally:
            seen.unpersist()
    return write


def overdue_stream(log: DataFrame, limit_seconds: int, delay: str = "1 hour", review: str = "review_id") -> DataFrame:
    """Starts that saw no further record of their job within the limit.

    ``log``: job, ``ts`` (TIMESTAMP), ``seq``, ``started``. Time is cut into slices as long as the limit, so
    what follows a start within it lies in the start's slice or the next one. Each two neighbouring slices are
    a window; when the watermark has passed one, the starts of its first slice are settled. A group holds the
    records of two slices of one job. Best with the RocksDB state store, which keeps groups off the heap.
    """
    limit = limit_seconds * 1_000_000
    record = F.struct(F.unix_micros("ts").alias("at"), "seq", "started")
    slices = F.window("ts", f"{2 * limit_seconds} seconds", f"{limit_seconds} seconds")
    groups = log.withWatermark("ts", delay).groupBy(review, slices).agg(F.collect_list(record).alias("records"))
    middle = F.unix_micros("window.start") + limit

    def late(records: Column) -> Column:
        judged = F.transform(records, lambda r, i: F.struct(r["at"].alias("at"), (
            r["started"] & (r["at"] < middle) & F.coalesce(F.get(records, i + 1)["at"] > r["at"] + limit, F.lit(True))).alias("late")))
        return F.filter(judged, lambda r: r["late"])

    starts = groups.select(review, F.explode(let(F.sort_array("records"), late)).alias("start"))
    return starts.select(review, F.timestamp_micros("start.at").alias("started_at"),
                         F.timestamp_micros(F.col("start.at") + limit).alias("overdue_at"))


def overdue_batch(log: DataFrame, limit_seconds: int, review: str = "review_id") -> DataFrame:
    """The batch twin of :func:`overdue_stream`: each start is compared with the record that follows."""
    timed = next_within(log, [review], F.date_trunc("day", "ts"), [F.col("ts"), F.col("seq")], F.col("ts"), "_following_ts")
    due = F.col("ts") + F.make_dt_interval(secs=F.lit(limit_seconds))
    return (timed.filter(F.col("started") & (F.col("_following_ts").isNull() | (F.col("_following_ts") > due)))
            .select(review, F.col("ts").alias("started_at"), due.alias("overdue_at")))


# Size of the quantile sketches: for n values a rank is missed by at most n * RANK_ERROR (99 % confidence).
SKETCH_SIZE, RANK_ERROR = 400, 0.0068


def per_minute(jobs: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Jobs, completions and waits per minute of arrival; late rows are dropped after ``delay``.

    ``jobs``: ``ts`` (TIMESTAMP), ``status``, ``wait_seconds``. A stream cannot hold all values, so the
    percentile comes from ``wait_sketch``, a quantile sketch of bounded size that is also given out:
    sketches of minutes merge into those of any longer time (:func:`merged_waits`). Up to
    ``SKETCH_SIZE`` values it is exact; beyond, see ``RANK_ERROR``.
    """
    timed = jobs.withWatermark("ts", delay) if jobs.isStreaming else jobs
    grouped = timed.groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("jobs"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"),
        F.max("wait_seconds").alias("max_wait_seconds"), F.kll_sketch_agg_double("wait_seconds", SKETCH_SIZE).alias("wait_sketch"))
    return grouped.select(F.col("window.start").alias("minute"), "jobs", "completed", "max_wait_seconds",
                          F.kll_sketch_get_quantile_double("wait_sketch", F.lit(0.95)).alias("approx_p95_wait_seconds"), "wait_sketch")


def merged_waits(minutes: DataFrame, by: Column, percent: float = 0.95) -> DataFrame:
    """A percentile of the waits of many minutes, from their sketches alone."""
    merged = minutes.groupBy(by).agg(F.sum("jobs").alias("jobs"), F.kll_merge_agg_double("wait_sketch", SKETCH_SIZE).alias("wait_sketch"))
    return merged.withColumn("approx_wait_seconds", F.kll_sketch_get_quantile_double("wait_sketch", F.lit(percent)))


def status_view(events: DataFrame) -> DataFrame:
    """Count per status, for complete mode."""
    known = events.filter(F.col("status").isin(*JOB_STATUSES))
    return known.groupBy("status").agg(F.count(F.lit(1)).alias("reviews"))


def replay(stream: DataFrame, out: str, checkpoint: str, write: Batch | None = None, mode: str = "append") -> None:
    """Run a stream over everything that has arrived, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if write is not None:
        writer = writer.foreachBatch(write)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    query = writer.start()
    query.awaitTermination()
