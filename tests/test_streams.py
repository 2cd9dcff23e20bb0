"""Streams cut into several micro-batches, and repeated ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.plans import stream_queries
from reviewlake.sources.manifest import MOST_FOLDERS, BucketTable
from reviewlake.streaming import streams as M

COMMIT = "repository_name string, pull_request_number long, head_sha string, received_at timestamp, seq long"


def commits(spark, *rows):
    """rows: (pull request, head, seq)"""
    frame = spark.createDataFrame([("o/r", pr, head, seq) for pr, head, seq in rows],
                                  "repository_name string, pull_request_number long, head_sha string, seq long")
    return frame.withColumn("received_at", F.timestamp_seconds("seq"))


def jobs_input(frame):
    return frame.withColumns({"delivery_id": F.concat(F.lit("d"), F.col("seq").cast("string")), "handled": F.lit(True),
                              "installation_id": F.lit(1), "repository_id": F.lit(2)})


def test_repeated_batches_add_no_jobs(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write = M.upsert_jobs(path)
    first = jobs_input(commits(spark, *[(1, "a", i) for i in range(50)], (2, "b", 60)))
    second = jobs_input(commits(spark, (1, "a", 70), (1, "c", 71)))
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 2)):
        write(batch, number)
    rows = M.state_table(spark, path, "review_id").read().collect()
    assert sorted((r.pull_request_number, r.head_sha, r.created_by) for r in rows) == [(1, "a", "d0"), (1, "c", "d71"), (2, "b", "d60")]


def test_a_repeat_of_an_old_delivery_makes_no_job(spark, tmp_path):
    deliveries, jobs = str(tmp_path / "deliveries"), str(tmp_path / "jobs")
    write = M.ingest_sink(deliveries, jobs)
    first = jobs_input(commits(spark, (1, "a", 1), (2, "b", 2))).withColumn("delivery_id", F.lit("d"))
    late = jobs_input(commits(spark, (3, "c", 900))).withColumn("delivery_id", F.lit("d"))
    for batch, number in ((first, 0), (first, 0), (late, 1), (late, 1)):
        write(batch, number)
    assert [(r.pull_request_number, r.head_sha) for r in M.state_table(spark, jobs, "review_id").read().collect()] == [(1, "a")]
    assert M.state_table(spark, deliveries, "delivery_id").read().count() == 1


def test_heads_over_batches_and_a_repeated_one(spark, tmp_path):
    heads, events = str(tmp_path / "heads"), str(tmp_path / "events")
    write = M.track_heads(heads, events)
    batches = [commits(spark, (1, "a", 1), (2, "x", 2)), commits(spark, (1, "b", 5), (1, "c", 6)), commits(spark, (1, "z", 3), (2, "x", 9))]
    for number, batch in enumerate(batches):
        write(batch, number)
        write(batch, number)
    rows = {(r.pull_request_number, r.head_sha, r.current_head) for r in spark.read.parquet(events).collect()}
    # The late head z never was the newest one: it is replaced on arrival.
    assert rows == {(1, "a", "c"), (1, "b", "c"), (1, "z", "c")}


def folder_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_overdue_does_not_depend_on_micro_batches(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    source = str(tmp_path / "log")
    rows = [(job, job * 40 + step * 100, job * 10 + step, step % 3 == 0) for job in range(12) for step in range(6) if (job + step) % 4]
    log = spark.createDataFrame(rows, "review_id long, at long, seq long, started boolean").select(
        "review_id", F.timestamp_seconds("at").alias("ts"), "seq", "started")
    closing = spark.createDataFrame([(99, 10_000, 1, False)], "review_id long, at long, seq long, started boolean").select(
        "review_id", F.timestamp_seconds("at").alias("ts"), "seq", "started")
    ordered = log.orderBy("ts").collect()
    for start in range(0, len(ordered), 9):  # one file per micro-batch, in order of arrival
        spark.createDataFrame(ordered[start:start + 9], log.schema).coalesce(1).write.mode("append").parquet(source)
    closing.coalesce(1).write.mode("append").parquet(source)
    stream = M.overdue_stream(folder_stream(spark, source, log.schema), 60, "2000 seconds")
    assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    out = str(tmp_path / "out")
    M.replay(stream, out, str(tmp_path / "state"))
    got = sorted((r.review_id, r.started_at) for r in spark.read.parquet(out).collect())
    want = sorted((r.review_id, r.started_at) for r in M.overdue_batch(log, 60).collect())
    assert got == want and want


def test_overdue_stream_takes_any_job_key_and_starts_at_one_time(spark, tmp_path):
    rows = [("a", 0, 1, True), ("a", 60, 2, True), ("a", 121, 3, False), (None, 5, 4, True), ("b", 59, 5, True), ("b", 59, 6, True), ("b", 59, 7, False)]
    log = spark.createDataFrame([*rows, ("end", 10_000, 9, False)], "job string, at long, seq long, started boolean").select(
        "job", F.timestamp_seconds("at").alias("ts"), "seq", "started")
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.coalesce(1).write.parquet(source)
    M.replay(M.overdue_stream(folder_stream(spark, source, log.schema), 60, "2000 seconds", "job"), out, str(tmp_path / "state"))
    found = spark.read.parquet(out).select("job", F.unix_seconds("started_at"), F.unix_seconds("overdue_at")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", 60, 120), (None, 5, 65)], key=str)


def test_a_load_is_written_and_read_as_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 20)
    rows = spark.range(200).withColumn("load", F.col("id") % 2)
    path, files = str(tmp_path / "in"), stream_queries.load_files(rows)
    assert files == 4
    for number in (0, 1, 7):  # the last load has no rows, and as many files
        stream_queries.land(rows.filter(F.col("load") == number), path, files)
    assert len(spark.read.parquet(path).inputFiles()) == 12
    batches = {}

    def note(batch, number):
        batches[number] = (sorted(r.load for r in batch.select("load").distinct().collect()), batch.rdd.getNumPartitions())

    M.replay(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path), str(tmp_path / "out"), str(tmp_path / "state"), note)
    assert {k: loads for k, (loads, _) in batches.items()} == {0: [0], 1: [1], 2: []} and batches[0][1] > 1


def test_minutes_equal_the_batch_form(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"),
                                   F.when(F.col("id") % 3 == 0, "completed").otherwise("failed").alias("status"),
                                   (F.col("id") % 11).cast("double").alias("wait_seconds"))
    source = str(tmp_path / "in")
    rows.repartitionByRange(4, "ts").write.parquet(source)
    M.replay(M.per_minute(spark.readStream.schema(rows.schema).parquet(source), "0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.minute: (r.jobs, r.completed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.minute: (r.jobs, r.completed) for r in M.per_minute(rows).collect()}
    last = max(want)
    assert got == {minute: value for minute, value in want.items() if minute != last}


def test_sketches_of_minutes_merge_within_their_bound(spark):
    rng = random.Random(5)
    values = [rng.lognormvariate(0, 3) for _ in range(60_000)]
    rows = spark.createDataFrame([(i % 600, v) for i, v in enumerate(values)], "at long, wait_seconds double").select(
        F.timestamp_seconds("at").alias("ts"), F.lit("completed").alias("status"), "wait_seconds")
    minutes = M.per_minute(rows)
    for row in minutes.collect():
        own = sorted(v for i, v in enumerate(values) if i % 600 // 60 == row.minute.timestamp() // 60)
        rank = sum(v <= row.approx_p95_wait_seconds for v in own)
        assert row.jobs == len(own) and abs(rank - 0.95 * len(own)) <= len(own) * M.RANK_ERROR + 1
    (whole,) = M.merged_waits(minutes, F.lit("all")).collect()
    assert abs(sum(v <= whole.approx_wait_seconds for v in values) - 0.95 * len(values)) <= len(values) * M.RANK_ERROR + 1


def bucket_folders(frame):
    return {re.search(r"/bucket=(\d+)/", f)[1] for f in frame.inputFiles()}


def test_a_micro_batch_reads_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write = M.upsert_by_key(path, "review_id", ("created_at",), buckets=16)
    rows = lambda ids: spark.createDataFrame([(f"r{i}", i) for i in ids], "review_id string, created_at long")
    for number in range(30):
        write(rows(range(number * 40, number * 40 + 40)), number)
        table = M.state_table(spark, path, "review_id")
        assert all(len(folders) <= MOST_FOLDERS for folders in table.state["folders"].values())
    table = M.state_table(spark, path, "review_id")
    few = rows([5, 700])
    touched = table.touched(few)
    read = table.read(touched)
    assert bucket_folders(read) == {str(b) for b in touched} and len(touched) <= 2
    everything = table.read()
    assert everything.count() == 1200 and len(bucket_folders(everything)) == 16
    # One bucket is at most so many folders, and a folder of so few rows is one file.
    assert len(read.inputFiles()) <= 2 * MOST_FOLDERS
    write(few, 29)  # a repeat
    write(few, 30)  # known keys
    assert M.state_table(spark, path, "review_id").read().count() == 1200


def test_a_batch_that_died_before_its_commit_is_repeated_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "jobs")
    write = M.upsert_by_key(path, "review_id", ("created_at",), buckets=4)
    rows = lambda *ids: spark.createDataFrame([(f"r{i}", i) for i in ids], "review_id string, created_at long")
    write(rows(1, 2), 0)
    with monkeypatch.context() as broken:
        broken.setattr(BucketTable, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write(rows(2, 3), 1)
    assert M.state_table(spark, path, "review_id").read().count() == 2  # what was written is not named
    write(rows(2, 3), 1)
    assert sorted(r.review_id for r in M.state_table(spark, path, "review_id").read().collect()) == ["r1", "r2", "r3"]


def test_the_least_arrival_counts_in_any_order(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "delivery_id string, seq long, received_at timestamp, authentic boolean, body_ok boolean, headers_ok boolean, handled boolean, target_ok boolean"
    rows = [(f"d{i % 40}", i, 1000 + (i * 37) % 500) for i in range(200)] + [("end", 999, 10**6)]
    cuts = [rows[150:200], rows[:50], rows[100:150], rows[50:100], rows[:50], rows[200:]]
    for cut in cuts:
        frame = spark.createDataFrame(cut, "delivery_id string, seq long, at long").select(
            "delivery_id", "seq", F.timestamp_seconds("at").alias("received_at"), *[F.lit(True).alias(c) for c in ("authentic", "body_ok", "headers_ok", "handled", "target_ok")])
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    M.replay(M.dedup_stream(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    want = {}
    for name, seq, at in rows[:200]:
        want[name] = min(want.get(name, (at, seq)), (at, seq))
    got = {r.delivery_id: (int(r.received_at.timestamp()), r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
