"""Operators against brute force on generated data, also with one key holding a third of all rows."""

import json
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.functions.text import count_lines, escaped_length, split_lines
from reviewlake.operators import diff as D
from reviewlake.operators import evaluate as K
from reviewlake.operators import scope as C
from reviewlake.operators import stats as L
from reviewlake.operators.skew import lookup_join, next_within, number_within

SEPARATORS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_line_splitting_matches_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "\U0001d4b3", "日", '"', "\\", "\t", "\x01", *SEPARATORS]) for _ in range(rng.randint(0, 9)))
             for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in frame.select(t, split_lines(t).alias("lines"), count_lines(t).alias("n"), count_lines(t, "bytes").alias("b"),
                            escaped_length(t).alias("e")).collect():
        assert row.lines == row.t.splitlines()
        assert row.n == len(row.t.splitlines())
        assert row.b == len(row.t.encode().splitlines())
        assert row.e == len(json.dumps(row.t)) - 2


def edit(rng):
    """Random edits of a file: the patch text and the line sets it must give."""
    old = new = 1
    text, sets = [], {"added": set(), "new": set(), "removed": set()}
    for _ in range(rng.randint(1, 4)):
        gap = rng.randint(0, 5)
        old, new = old + gap, new + gap
        body = [rng.choice("+- ") for _ in range(rng.randint(1, 8))]
        olds, news = sum(k in "- " for k in body), sum(k in "+ " for k in body)
        side = lambda start, n: f"{start if n else start - 1}" + ("" if n == 1 and rng.random() < 0.5 else f",{n}")
        # An empty side names the line before it, so it may not precede the last hunk's end.
        header_old, header_new = (old, new)
        text.append(f"@@ -{header_old}" + ("" if olds == 1 and rng.random() < 0.5 else f",{olds}")
                    + f" +{header_new}" + ("" if news == 1 and rng.random() < 0.5 else f",{news}") + " @@ context")
        for kind in body:
            text.append(kind + rng.choice(["", "x", "@@ -1 +1 @@", "\\"]))
            if kind == "+":
                sets["added"].add(new)
            if kind == "-":
                sets["removed"].add(old)
            if kind != "-":
                sets["new"].add(new)
            old, new = old + (kind != "+"), new + (kind != "-")
        if rng.random() < 0.2:
            text.append("\\ No newline at end of file")
    return "\n".join(text), sets


def test_diff_round_trip(spark):
    rng = random.Random(2)
    cases = [edit(rng) for _ in range(500)]
    frame = spark.createDataFrame([(i, "f.py", patch) for i, (patch, _) in enumerate(cases)],
                                  "review_id long, filename string, patch string")
    assert D.diff_errors(frame).filter("error IS NOT NULL").count() == 0
    got = {}
    for row in D.changed_lines(frame).collect():
        got.setdefault(row.review_id, {"added": set(), "new": set(), "removed": set()})[row.side].add(row.line)
    assert got == {i: sets for i, (_, sets) in enumerate(cases)}
    # Rebuilding both sides of every line gives back the patch bodies.
    lines = D.diff_lines(frame).orderBy("review_id", "pos").collect()
    bodies = Counter((r.review_id, r.text) for r in lines)
    assert bodies == Counter((i, line) for i, (patch, _) in enumerate(cases) for line in patch.split("\n")
                             if not line.startswith("@@") and not line.startswith("\\"))


def test_runs_are_the_added_lines(spark):
    rng = random.Random(12)
    cases = [edit(rng) for _ in range(300)]
    cases.append(("@@ -0,0 +1,900 @@\n" + "\n".join(["+x"] * 900), {"added": set(range(1, 901))}))
    cases.append(("\n".join(f"@@ -{2 * i + 1},1 +{2 * i + 1},2 @@\n+x\n y" for i in range(300)), {"added": {2 * i + 1 for i in range(300)}}))
    cases.append(("@@ -1,0 +1,2 @@\n+a\n+b\n@@ -1,0 +3,1 @@\n+c", {"added": {1, 2, 3}}))
    frame = spark.createDataFrame([(i, patch) for i, (patch, _) in enumerate(cases)] + [(-1, None), (-2, "broken")], "i int, patch string")
    runs = frame.select("i", D.added_runs(F.col("patch")).alias("runs"))
    for row in runs.collect():
        if row.i < 0:
            assert row.runs is None
            continue
        lines = [n for first, last in row.runs for n in range(first, last + 1)]
        assert lines == sorted(cases[row.i][1]["added"])
        assert all(a.last + 1 < b.first for a, b in zip(row.runs, row.runs[1:]))  # as long as they can be
    tested = runs.select("i", F.explode(F.sequence(F.lit(-1), F.lit(905))).alias("line"), "runs").select(
        "i", "line", D.in_runs(F.col("runs"), F.col("line")).alias("hit"))
    for row in tested.collect():
        assert row.hit == (None if row.i < 0 else row.line in cases[row.i][1]["added"])


def walked(items, most, total, factor):
    """The walk as the rules say it: by name, taking what fits."""
    taken, left, out = 0, total, []
    for name, size, used in sorted(items):
        reason = "count" if taken >= most else "total" if size * factor > left else None
        out.append((name, size, reason))
        if reason is None:
            taken, left = taken + 1, left - used
    return Counter(out)


def test_two_phase_walk(spark):
    rng = random.Random(7)
    reviews = {i: [(f"f{rng.randint(0, 40):02}", rng.choice([0, 1, 2, 5, 9, 30, 60, 100, 300]), 0) for _ in range(rng.randint(1, 60))] for i in range(150)}
    reviews[500] = [(f"n{i:05}", 4000 - i, 0) for i in range(4000)]  # every file smaller than all before
    reviews[501] = [(f"n{i:05}", rng.randint(0, 90), 0) for i in range(4000)]
    for factor, share in ((1, 1.0), (2, 1.0), (2, 0.5)):
        rows = [(r, n, s, int(s * factor * share)) for r, items in reviews.items() for n, s, _ in items]
        frame = spark.createDataFrame(rows, "review_id int, filename string, size int, used int")
        got = {}
        decided = C.walk_budget(frame, "review_id", "filename", "size", F.col("used"), factor, 5, 200, ("count", "total"))
        for r in decided.collect():
            got.setdefault(r.review_id, Counter())[r.filename, r.size, r.reason] += 1
        assert got == {r: walked([(n, s, int(s * factor * share)) for n, s, _ in items], 5, 200, factor) for r, items in reviews.items()}


def test_few_candidates_are_gathered(spark):
    rng = random.Random(8)
    able = spark.createDataFrame([(1, f"n{i:06}", rng.randint(1, 50_000), 0) for i in range(50_000)], "review_id int, _name string, _size long, _used long")
    assert C._thinned(able, "review_id", 20).count() < 5000


def test_match_counts_against_counters(spark):
    rng = random.Random(4)
    draw = lambda n: [(f"c{rng.randint(0, 3)}", "f", rng.randint(1, 4), rng.choice("ab")) for _ in range(n)]
    expected, found = draw(200), draw(300)
    schema = "case_id string, file string, line int, category string"
    got = {r.case_id: (r.tp, r.fp, r.fn) for r in K.match_counts(
        spark.createDataFrame(expected, schema), spark.createDataFrame(found, schema), ["case_id"]).collect()}
    for case in got:
        e, f = Counter(x for x in expected if x[0] == case), Counter(x for x in found if x[0] == case)
        assert got[case] == (sum((e & f).values()), sum((f - e).values()), sum((e - f).values()))


def skewed(spark, n=6000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(700)).cast("int").alias("line"), F.col("id").alias("idx"))


def test_a_hot_key_with_equal_rows_is_split(spark):
    """One key, one text: the engine still deals its rows to several tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id") % 1000).alias("k"), F.lit("not json").alias("text"))
        lookup = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        joined = lookup_join(facts, lookup, ["k"])
        total = joined.agg(F.sum("v").alias("n"))
        assert total.collect()[0]["n"] == 200_000
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_numbering_and_next_match_windows(spark):
    rows = skewed(spark)
    order = [F.col("line"), F.col("idx")]
    window = Window.partitionBy("k").orderBy(*order)
    want = {r.idx: (r.rn, r.nx) for r in rows.select("idx", F.row_number().over(window).alias("rn"),
                                                    F.lead("idx").over(window).alias("nx")).collect()}
    coarse = F.floor(F.col("line") / 16)
    numbered = number_within(rows, ["k"], coarse, order, "rn")
    both = next_within(numbered, ["k"], coarse, order, F.col("idx"), "nx")
    assert {r.idx: (r.rn, r.nx) for r in both.collect()} == want


def test_order_statistics(spark):
    rows = skewed(spark).withColumn("v", (F.col("line") - 300) / 7.0)
    got = {r.k: (r.n, r.p50, r.p95) for r in L.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).collect()}
    for row in rows.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
        n = len(row.v)
        rank = lambda p: row.v[max(0, -int(-(n * p) // 1) - 1)]
        assert got[row.k] == (n, rank(0.5), rank(0.95))
    single = L.nearest_rank(spark.range(1, 51).withColumn("v", F.col("id")), "v", {"p95": 0.95, "p50": 0.5}).first()
    assert (single.p95, single.p50) == (48, 25)
    assert L.nearest_rank(spark.range(0).withColumn("v", F.col("id")), "v", {"p": 0.5}).first().p is None


def test_provider_median_is_averaged(spark):
    calls = spark.createDataFrame([("completed", 1.0, 10, None), ("completed", 4.0, 20, 3), ("failed", 9.0, None, None)],
                                  "status string, seconds double, prompt_tokens int, candidate_tokens int")
    row = L.provider_stats(calls).first()
    assert (row.attempted, row.completed, row.successful_median_seconds, row.successful_p95_seconds) == (3, 2, 2.5, 4.0)
    assert (row.average_prompt_tokens, row.average_candidate_tokens) == (15.0, None)


def test_fingerprint_sees_every_change_but_no_order(spark):
    files = [("a", b"1"), ("b", b"2"), ("c", b"3")]
    digest = lambda rows: K.dataset_fingerprint(
        spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary"), "name", "content").first().fingerprint
    base = digest(files)
    assert base == digest(files[::-1])
    others = [digest(files[:2]), digest([*files, files[0]]), digest([("a", b"2"), ("b", b"1"), ("c", b"3")]), digest([*files, files[0], files[0]])]
    assert len({base, *others}) == 5
