"""Percentiles, time blocks and pages when values lie close together or one key holds most rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import lifecycle as H
from reviewlake.operators import serving as J
from reviewlake.operators import stats as L
from reviewlake.operators.reviewer import ReviewFailure, _FINDINGS, review_files


@pytest.mark.parametrize("shape", ["epoch", "one", "tiny", "wide", "negative"])
def test_no_task_orders_more_than_stated(spark, monkeypatch, shape):
    monkeypatch.setattr(L, "SMALL", 40)
    rng = random.Random(4)
    value = {"epoch": lambda: 1_700_000_000_000_000 + rng.randrange(10**6), "one": lambda: 7, "tiny": lambda: 1 + rng.random() / 1e6,
             "wide": lambda: 10 ** rng.uniform(-300, 300), "negative": lambda: -rng.randrange(1000, 1010) - rng.random()}[shape]
    values = {k: [float(value()) for _ in range(n)] for k, n in (("a", 3000), ("b", 900), ("c", 1))}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own] + [("a", None)], "k string, v double")
    ranks = {"p1": F.greatest(F.ceil(F.col("n") * 0.01), F.lit(1)), "p50": F.ceil(F.col("n") * 0.5), "last": F.col("n"), "none": F.col("n") + 1}
    members = L._narrowed(rows, ["k"], "v", ranks)
    assert members.groupBy("k", "_b").count().agg(F.max("count")).first()[0] <= 40
    for row in L.at_ranks(rows, ["k"], "v", ranks).collect():
        own = sorted(values[row.k])
        at = lambda p: own[max(0, -int(-(len(own) * p) // 1) - 1)]
        assert (row.n, row.p1, row.p50, row["last"], row.none) == (len(own), at(0.01), at(0.5), own[-1], None)
    whole = sorted(v for own in values.values() for v in own)
    assert L.nearest_rank(rows, "v", {"p99": 0.99}).first().p99 == whole[-(-len(whole) * 99 // 100) - 1]


def test_a_crowded_day_is_many_blocks(spark):
    rng = random.Random(6)
    rows = [(1, 1_600_000_000_000_000 + rng.randrange(3_600_000_000), i) for i in range(3000)]  # an hour of one job
    rows += [(1, 1_600_000_000_000_000 + 86_400_000_000 * d, 5000 + d) for d in range(5)] + [(2, 1_600_000_000_000_000 + i, 9000 + i) for i in range(50)]
    log = spark.createDataFrame(rows, "review_id long, at long, seq long").select("review_id", F.timestamp_micros("at").alias("ts"), "seq", F.lit("x").alias("stage"))
    stamp = F.unix_micros("ts")
    blocks = H.time_blocks(log, stamp, most=100)
    sizes = {(r.review_id, r._block): r["count"] for r in blocks.groupBy("review_id", "_block").count().collect()}
    assert max(sizes.values()) <= 100 and sum(r == 1 for r, _ in sizes) > 40 and sum(r == 2 for r, _ in sizes) == 1
    got = {r.seq: r.stage_seconds for r in H.stage_timeline(log, most=100).collect()}
    want = {}
    for job in (1, 2):
        own = sorted((at, seq) for r, at, seq in rows if r == job)
        want |= {seq: (own[i + 1][0] - at) / 1e6 if i + 1 < len(own) else None for i, (at, seq) in enumerate(own)}
    assert got == want


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(J, "SHALLOW", 50)
    rng = random.Random(2)
    rows = [(i, rng.choice([5, 9, rng.randrange(10**6)])) for i in range(2000)]  # two creation times hold two thirds
    jobs = spark.createDataFrame(rows, "id long, at long").select("id", F.timestamp_seconds("at").alias("created_at"))
    order = [i for _, i in sorted(((-at, -i) for i, at in rows))]
    order = [-i for i in order]
    for page in (1, 3, 4, 20, 38, 60, 99, 100, 101, 500):
        got = [r.id for r in J.list_reviews(jobs, page, 20).collect()]
        assert got == order[(page - 1) * 20:page * 20], page


def test_component_seconds_are_those_of_the_last_attempt(spark):
    rows = [(1, 10, "started"), (1, 15, "static_completed"), (1, 18, "ai_completed"), (1, 30, "started"), (1, 34, "static_completed"), (1, 41, "ai_completed"),
            (2, 5, "started"), (2, 9, "analysis_failed"), (3, 7, "static_completed"), (4, 1, "started"), (4, 3, "static_completed")]
    log = spark.createDataFrame(rows, "review_id long, at long, stage string").select("review_id", F.timestamp_seconds("at").alias("ts"), "stage")
    got = {r.review_id: (r.static_analysis_seconds, r.ai_analysis_seconds) for r in H.component_seconds(log).collect()}
    assert got == {1: (4.0, 7.0), 2: (None, None), 4: (2.0, None)}


def failing_reviewer():
    """Finds the word bug; cannot review a file that says crash, and with it no batch that holds one."""
    def review(lines):
        texts = lines["text"].to_pylist()
        if any("crash" in t for t in texts):
            raise ReviewFailure("ai_http_503", retryable=True)
        hit = [i for i, t in enumerate(texts) if "bug" in t]
        found = lines.take(pa.array(hit, pa.int64())).to_pylist()
        return pa.Table.from_pylist([dict(file=f["file"], file_path=f["filename"], line_number=f["line"], source="ai", category="bug",
                                                         severity="low", title="t", description=f["text"], suggestion=None) for f in found], schema=_FINDINGS)
    return review


def test_a_failing_file_leaves_its_batch_alone(spark):
    rows = [(1, "a.py", None, [(1, "x"), (2, "a bug"), (9, "bug")]), (1, "b.py", None, [(3, "crash")]), (1, "c.py", None, []), (2, "d.py", "invalid_diff_hunk", None),
            (2, "e.py", None, None), (3, "f.py", None, [(4, "bug")])]
    files = spark.createDataFrame(rows, "review_id long, filename string, refused string, added array<struct<line: long, text: string>>").coalesce(1)
    got = sorted((r.filename, r.outcome, r.error, r.retryable, r.line_number or 0) for r in review_files(files, failing_reviewer).collect())
    assert got == [("a.py", "reviewed", None, False, 2), ("a.py", "reviewed", None, False, 9), ("b.py", "failed", "ai_http_503", True, 0),
                   ("c.py", "reviewed", None, False, 0), ("d.py", "failed", "invalid_diff_hunk", False, 0), ("e.py", "reviewed", None, False, 0),
                   ("f.py", "reviewed", None, False, 4)]
