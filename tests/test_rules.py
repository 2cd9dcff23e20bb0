"""The documented rules, one row per case."""

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.policy import backoff_seconds, safe_error
from reviewlake.limits import Limits
from reviewlake.operators import diff as D
from reviewlake.operators import evaluate as K
from reviewlake.operators import findings as E
from reviewlake.operators import ingest as I
from reviewlake.operators import publish as G
from reviewlake.operators import report as R
from reviewlake.operators import scope as C
from reviewlake.schemas import REVIEW_FINDING

BASE = dict(file_path="pkg/core.py", line_number=5, source="ai", category="k", severity="medium",
            title="t", description="d", suggestion="s")


def files(spark, *rows):
    """rows: (filename, status, patch)"""
    return spark.createDataFrame([(1, *row) for row in rows], "review_id long, filename string, status string, patch string")


def findings(spark, *changes):
    rows = [{"review_id": 1, "idx": i, **BASE, **change} for i, change in enumerate(changes)]
    return spark.createDataFrame(rows, REVIEW_FINDING)


def lookup(spark):
    """One file of eight lines; the odd ones are added."""
    return spark.createDataFrame([(1, "pkg/core.py", 8, [(1, 1), (3, 3), (5, 5), (7, 7)])],
                                 "review_id long, file_path string, line_count int, added array<struct<first: long, last: long>>")


# --- deliveries ---------------------------------------------------------------------------

PAYLOAD = {"action": "opened", "repository": {"id": 1, "full_name": "o/r"}, "installation": {"id": 3},
           "pull_request": {"number": 7, "head": {"sha": "a" * 40}, "base": {"sha": "b" * 40}}}


def deliver(spark, *rows, secret="s"):
    """rows: (delivery_id, event, body, signature or None for a good one)"""
    made = []
    for seq, (delivery, event, body, signature) in enumerate(rows):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        good = "sha256=" + hmac.new(secret.encode(), raw, hashlib.sha256).hexdigest()
        made.append((delivery, event, good if signature is None else signature, bytearray(raw), seq))
    frame = spark.createDataFrame(made, "delivery_id string, event_type string, signature string, body binary, seq long")
    return I.prepare(frame.withColumn("received_at", F.timestamp_seconds("seq")), secret)


def dispositions(frame):
    return [r.disposition for r in I.delivery_disposition(frame).orderBy("seq").collect()]


def test_published_signature_vector(spark):
    row = spark.createDataFrame([(bytearray(b"Hello, World!"),
                                  "sha256=757107ea0eb2509fc211221cce984b8a37570b6d7586c22c46f4379c8b043e17")],
                                "body binary, signature string")
    assert I.verify_signature(row, "It's a Secret to Everybody").first().authentic
    assert not I.verify_signature(row, "another").first().authentic


def test_long_secret_is_hashed_first(spark):
    assert dispositions(deliver(spark, ("d", "pull_request", PAYLOAD, None), secret="k" * 100)) == ["accepted"]


def test_missing_secret_fails_closed(spark):
    with pytest.raises(ValueError):
        I.verify_signature(spark.range(1), "")


def test_signature_is_the_first_check(spark):
    """Every other fault may be there too: without the right header the answer is the same."""
    whole, torn = json.dumps(PAYLOAD).encode(), b'{"action":'
    digest = hmac.new(b"s", whole, hashlib.sha256).hexdigest()
    headers = [digest, f"SHA256={digest}", f"sha256={digest.upper()}", f"sha256={digest[:-1]}", f" sha256={digest}"]
    rows = [(f"d{i}", "pull_request", body, header) for i, (header, body) in enumerate((h, b) for h in headers for b in (whole, torn))]
    rows += [("", "", torn, "none"), ("ok", "pull_request", whole, f"sha256={digest}")]
    assert dispositions(deliver(spark, *rows)) == ["unauthenticated"] * (len(rows) - 1) + ["accepted"]


@pytest.mark.parametrize("body", [b"", b"   ", b"[{}]", b'"text"', b"true", b"17", b"{}{}", b'{"x": }', b'{"k": 0, "k": 0}', "{\"é\": 1}".encode("latin-1"), b"\xef\xbb\xbf{}"])
def test_only_one_utf8_object_is_a_body(spark, body):
    assert dispositions(deliver(spark, ("d", "ping", body, None), ("e", "ping", b" \n{ }\t", None))) == ["invalid", "ignored"]


@pytest.mark.parametrize("change", [
    {"repository": {"id": True, "full_name": "o/r"}}, {"repository": {"id": "1", "full_name": "o/r"}},
    {"repository": {"id": 1, "full_name": ""}}, {"repository": {"id": 1, "full_name": "x" * 256}},
    {"repository": {"id": 1.0, "full_name": "o/r"}}, {"installation": {"id": 0}}, {"installation": None},
    {"pull_request": {"number": 7, "head": {"sha": "a" * 39}}}, {"pull_request": {"number": 7, "head": {"sha": "a" * 40 + "\n"}}},
    {"pull_request": {"number": -7, "head": {"sha": "a" * 40}}},
    {"pull_request": {"number": 7, "head": {"sha": "a" * 40}, "base": {"sha": "b"}}}])
def test_target_is_strict(spark, change):
    rows = deliver(spark, ("d", "pull_request", {**PAYLOAD, **change}, None), ("e", "push", {**PAYLOAD, **change}, None))
    assert dispositions(rows) == ["invalid", "ignored"]


def test_optional_base_and_header_checks(spark):
    no_base = {**PAYLOAD, "pull_request": {"number": 7, "head": {"sha": "A" * 40}, "base": {"sha": None}}}
    rows = deliver(spark, ("\td1 ", " pull_request", no_base, None), ("", "pull_request", PAYLOAD, None),
                   ("x" * 256, "pull_request", PAYLOAD, None), ("d2", "y" * 101, PAYLOAD, None))
    assert dispositions(rows) == ["accepted", "invalid", "invalid", "invalid"]


def test_order_of_checks_in_a_redelivery(spark):
    broken = {**PAYLOAD, "installation": {"id": "x"}}
    rows = deliver(spark, ("d", "pull_request", broken, None), ("d", "pull_request", PAYLOAD, None),
                   ("d", "pull_request", PAYLOAD, None), ("d", "pull_request", broken, None), ("p", "ping", {}, None), ("p", "ping", {}, None))
    assert dispositions(rows) == ["invalid", "accepted", "duplicate", "invalid", "ignored", "duplicate"]


def test_one_job_per_commit(spark):
    rows = deliver(spark, *[(f"d{i}", "pull_request", PAYLOAD, None) for i in range(100)])
    jobs, links = I.deliveries_to_jobs(I.dedup_deliveries(rows))
    assert jobs.count() == 1 and links.select("review_id").distinct().count() == 1 and links.count() == 100
    assert jobs.first().created_by == "d0"


# --- scope ----------------------------------------------------------------------------------

@pytest.mark.parametrize("bad", [{"max_files": 0}, {"ai_max_files": 21}, {"ai_max_retries": 3}, {"review_task_limit_seconds": 9},
                                 {"max_files": True}])
def test_limits_are_checked(bad):
    with pytest.raises(ValueError):
        Limits(**bad)


# --- diffs -------------------------------------------------------------------------------------

def sides(spark, patch):
    out = {"added": set(), "new": set(), "removed": set()}
    for row in D.changed_lines(files(spark, ("a.py", "modified", patch))).collect():
        out[row.side].add(row.line)
    return out


def test_positions(spark):
    patch = "@@ -4,4 +4,3 @@ class A\n keep\n-gone\n-gone too\n+fresh\n keep\n@@ -20 +19,2 @@\n-one\n+two\n+three"
    assert sides(spark, patch) == {"added": {5, 19, 20}, "new": {4, 5, 6, 19, 20}, "removed": {5, 6, 20}}


# --- findings -------------------------------------------------------------------------------------

@pytest.mark.parametrize("change,general,ai", [
    ({}, True, True), ({"line_number": True}, False, False), ({"line_number": 2.0}, False, False), ({"line_number": "2"}, False, False),
    ({"title": 5}, False, False), ({"title": ""}, False, False), ({"extra": 1}, False, False), ({"suggestion": None}, True, False),
    ({"suggestion": ""}, True, False), ({"suggestion": 5}, False, False), ({"category": "c" * 129}, False, False),
    ({"line_number": 2**40}, False, False)])
def test_strict_items(spark, change, general, ai):
    item = spark.createDataFrame([(json.dumps({**BASE, **change}),)], "raw string").select(F.parse_json("raw").alias("item"))
    row = E.strict_schema(item).first()
    strict = E.strict_schema(item, ai=True).first()
    direct = item.select(E.item_ok(F.col("item")).alias("ok")).first()
    assert (row.schema_ok, strict.schema_ok) == (general, ai)
    if change.get("line_number") != 2**40:
        assert direct.ok == ai


def answer(*items, **more):
    return json.dumps({"findings": list(items), **more})


@pytest.mark.parametrize("raw, finish, error", [
    # how the call ended is asked before anything is read
    *[(text, end, "ai_incomplete_response") for text in (answer(1), "no json") for end in ("SAFETY", "stop", "", None)],
    # what is around the one object makes it no JSON
    *[(text, "STOP", "invalid_json") for text in ("", answer() + ";", "Sure: " + answer(), "```\n" + answer() + "\n```", answer()[:-1], "{'findings': []}")],
    # one key, and that a list
    *[(text, "STOP", "invalid_response_envelope") for text in (json.dumps([answer()]), "null", "3", '"findings"', answer(note=None), '{"Findings": []}',
                                                                *[json.dumps({"findings": x}) for x in (None, 0, "[]", {"0": {}})])],
    # any items will do here, as long as there are not too many
    *[(answer(*[None] * n), "STOP", None if n <= Limits().max_findings_per_response else "ai_invalid_response")
      for n in (0, 1, Limits().max_findings_per_response, Limits().max_findings_per_response + 1, 400)]])
def test_what_an_answer_must_look_like(spark, raw, finish, error):
    row = spark.createDataFrame([(raw, finish)], "raw string, finish_reason string")
    assert E.check_envelope(row).first().envelope_error == error


@pytest.mark.parametrize("second,error", [
    ({}, None), ({"line_number": 9}, "ai_invalid_location"), ({"source": "ruff"}, "ai_invalid_location"),
    ({"file_path": "invented.py"}, "ai_invalid_location"), ({"severity": "critical"}, "ai_invalid_response"), ({"suggestion": ""}, "ai_invalid_response")])
def test_one_bad_item_voids_the_answer(spark, second, error):
    raw = json.dumps({"findings": [BASE, {**BASE, **second}]})
    answer = spark.createDataFrame([(1, "pkg/core.py", raw, "STOP")], "review_id long, file_path string, raw string, finish_reason string")
    row = E.validate_model_responses(answer, lookup(spark)).first()
    assert (row.error, row.findings_count) == (error, 2 if error is None else None)


def test_report_without_findings(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "failed")], "review_id long, status string")
    none = E.validate_findings(findings(spark, {}).limit(0), lookup(spark))
    states = spark.createDataFrame([(1, "completed", "disabled"), (2, "failed", "failed")], "review_id long, static_analysis string, ai_analysis string")
    reports = R.build_reports(jobs, none, states).collect()
    assert sorted((r.review_id, r.page, r.summary.total_findings, r.findings, r.original_findings, r.rejected_findings) for r in reports) == [
        (1, 0, 0, [], [], []), (2, 0, 0, [], [], [])]
    assert {r.review_id: r.component_errors for r in reports} == {
        1: {}, 2: {"static_analysis": "static_analysis_failed", "ai_analysis": "ai_analysis_failed"}}


def test_reports_hold_everything_in_pages(spark):
    """Many rows merged into one finding, refused ones between them, and pages far smaller than the lists."""
    rows = [{"line_number": 5, "title": f"t{i:03}", "source": "ai" if i % 2 else "ruff"} for i in range(25)]
    rows += [{"line_number": 3, "category": f"c{i % 4}", "severity": "high"} for i in range(8)] + [{"line_number": 2}, {"line_number": 99}, {"file_path": "no.py"}]
    checked = E.validate_findings(findings(spark, *rows), lookup(spark))
    jobs = spark.createDataFrame([(1, "completed")], "review_id long, status string")
    pages = sorted(R.build_reports(jobs, checked, page_size=4).collect(), key=lambda r: r.page)
    assert [r.page for r in pages] == list(range(9)) and all(max(map(len, (r.findings, r.original_findings, r.rejected_findings))) <= 4 for r in pages)
    originals = [f for r in pages for f in r.original_findings]
    assert [f["index"] for f in originals] == list(range(36)) and [f["title"] for f in originals[:25]] == [f"t{i:03}" for i in range(25)]
    assert [(f["index"], f["reason"]) for r in pages for f in r.rejected_findings] == [(33, "outside_reviewed_changes"), (34, "invalid_line_number"), (35, "unknown_file")]
    found = [f for r in pages for f in r.findings]
    assert [(f.line_number, f.category, f.part) for f in found] == [(3, f"c{i}", 0) for i in range(4)] + [(5, "k", i) for i in range(7)]
    indices = {}
    for f in found:
        indices.setdefault((f.line_number, f.category), []).extend(f.original_indices)
    assert indices == {(5, "k"): list(range(25)), **{(3, f"c{i}"): [25 + i, 29 + i] for i in range(4)}}
    assert {f.title for f in found if f.line_number == 5} == {"t001"} and all(f.sources == ["ai", "ruff"] for f in found if f.line_number == 5)
    assert (pages[0].summary.total_findings, pages[0].summary.high, pages[0].summary.medium) == (5, 4, 1)


# --- publication ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("found, size", [(1, 50), (50, 50), (51, 50), (137, 50), (9, 4)])
def test_batches_are_full_but_the_last(spark, found, size):
    rows = G.annotations(R.merge_findings(findings(spark, *[{"line_number": 3 * i + 1, "category": f"c{i % 2}"} for i in range(found)])))
    batched = G.batch(rows, size).orderBy("batch", "position").collect()
    assert [(r.batch, r.position) for r in batched] == [(i // size, i % size) for i in range(found)]
    assert [r.start_line for r in batched] == sorted(3 * i + 1 for i in range(found))
    published = rows.filter("start_line % 2 = 0")  # what came through before the connection broke
    left = G.pending_annotations(rows, published)
    assert {r.start_line for r in left.collect()} == {3 * i + 1 for i in range(found) if (3 * i + 1) % 2}


def test_bad_location_blocks_the_review(spark):
    rows = G.annotations(R.merge_findings(findings(spark, {}, {"line_number": 500})))
    changed = spark.createDataFrame([(1, "pkg/core.py", 5)], "review_id long, filename string, line long")
    assert G.block_invalid(rows, changed).count() == 0
    assert G.block_invalid(rows.filter("start_line = 5"), changed).count() == 1


@pytest.mark.parametrize("status,ai,found,limited,expected", [
    ("completed", "completed", 0, False, "success"), ("failed", "failed", 0, False, "action_required"),
    ("completed", "disabled", 0, False, "neutral"), ("completed", "completed", 1, False, "neutral"),
    ("completed", "completed", 0, True, "neutral"), ("completed", "failed", 1, False, "action_required")])
def test_conclusions(spark, status, ai, found, limited, expected):
    row = spark.createDataFrame([(status, "completed", ai, found, limited)],
                                "status string, static_analysis string, ai_analysis string, total_findings long, scope_limited boolean")
    assert G.conclusion(row).first().conclusion == expected


def test_message_is_cut_and_suggestion_optional(spark):
    rows = findings(spark, {"line_number": 2, "suggestion": None, "description": "d" * 4000}, {"line_number": 3, "suggestion": "s" * 4000, "description": "d" * 4000})
    got = [r.message for r in G.annotations(R.merge_findings(rows)).orderBy("start_line").collect()]
    assert got[0] == "d" * 4000
    assert got[1] == ("d" * 4000 + "\nSuggestion: " + "s" * 4000)[:8000]


# --- jobs and scoring ------------------------------------------------------------------------------------

def test_errors_and_delays(spark):
    rows = spark.createDataFrame([("github_http_503",), ("github_http_5034",), ("token=abc",), ("analyzer_timeout",), (None,)], "e string")
    assert [r[0] for r in rows.select(safe_error(F.col("e"))).collect()] == [
        "github_http_503", "processing_error", "processing_error", "analyzer_timeout", "processing_error"]
    delays = spark.createDataFrame([(1, None), (2, None), (3, 500), (4, 10)], "a int, r int")
    assert [r[0] for r in delays.select(backoff_seconds(F.col("a"), F.col("r"))).collect()] == [30, 60, 500, 240]


def test_one_to_one_scoring(spark):
    label = spark.createDataFrame([("c", "x.py", 2, "security")], "case_id string, file string, line int, category string")
    twice = label.unionByName(label).withColumnsRenamed({"file": "file_path", "line": "line_number"})
    row = K.scores(K.match_counts(label, twice, ["case_id"])).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 0)
    missed = K.scores(K.match_counts(label, twice.limit(0), ["case_id"])).first()
    assert (missed.fn, missed.precision, missed.recall) == (1, None, 0.0)


def test_recorded_totals_give_recorded_scores(spark):
    row = K.scores(spark.createDataFrame([(6, 16, 14)], "tp long, fp long, fn long")).first()
    assert (row.precision, row.recall, row.f1) == (6 / 22, 0.3, 12 / 42)


def test_experiment_without_completed_case(spark):
    label = spark.createDataFrame([("c", "x.py", 2, "security")], "case_id string, file string, line int, category string")
    found = spark.createDataFrame([], "experiment string, case_id string, file_path string, line_number int, category string")
    status = spark.createDataFrame([("B", "c", "failed"), ("A", "c", "completed")], "experiment string, case_id string, status string")
    rows = {r.experiment: r for r in K.experiment_summary(label, found, status).collect()}
    assert (rows["B"].completed_cases, rows["B"].total_cases, rows["B"].tp, rows["B"].f1) == (0, 1, None, None)
    assert (rows["A"].fn, rows["A"].precision, rows["A"].recall) == (1, None, 0.0)


def test_summary_of_rows_is_that_of_merged_rows_and_texts_stay_behind(spark):
    levels = ["high", "medium", "low", "odd", None]
    rows = [(i % 3, "a.py", i % 4, "x", levels[i % 5], "ruff", f"t{i % 2}", "d", None if i % 2 else "s", i) for i in range(40)]
    found = spark.createDataFrame(rows, "review_id long, file_path string, line_number int, category string, severity string, source string, title string, description string, suggestion string, idx long")
    merged = R.merge_findings(found)
    assert sorted(R.accepted_summary(found).collect()) == sorted(R.severity_summary(merged).collect())
    rank = lambda r: (levels.index(r.severity) if r.severity in levels[:3] else 3, r.source, r.title, r.description, r.suggestion or "", r.idx)
    for row in merged.collect():
        best = min((r for r in found.collect() if (r.review_id, r.line_number) == (row.review_id, row.line_number)), key=rank)
        assert (row.severity, row.title, row.suggestion) == (best.severity, best.title, best.suggestion)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan  # the representative and its order would both carry the texts
    files = spark.createDataFrame([("a.py", 9, [(1, 3)], 0)], "file_path string, line_count int, added array<struct<first: int, last: int>>, review_id long")
    judged = E.validate_findings(found, files).select("review_id", "idx", "reason")
    joined = judged._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "title" not in joined and judged.filter("reason IS NULL").count() == sum(r.review_id == 0 and r.line_number > 0 and r.severity in levels[:3] for r in found.collect())


def test_schema_test_of_typed_columns_is_that_of_the_item(spark):
    items = ['{"file_path":"a","line_number":1,"source":"ai","category":"c","severity":"low","title":"t","description":"d","suggestion":"s"}',
             '{"file_path":"a","line_number":1,"source":"ai","category":"c","severity":"low","title":"t","description":"d"}',
             '{"file_path":"a","line_number":99999999999,"source":"ai","category":"c","severity":"low","title":"t","description":"d","suggestion":"s"}',
             '{"file_path":"a","line_number":0,"source":"ai","category":"c","severity":"low","title":"t","description":"d","suggestion":"s"}', '[]', 'null']
    rows = E.strict_schema(spark.createDataFrame([(i,) for i in items], "raw string").select(F.parse_json("raw").alias("item")))
    found = rows.select("ai_schema_ok", E.item_ok(F.col("item")).alias("own")).collect()
    assert [r.ai_schema_ok for r in found] == [r.own for r in found] == [True, False, True, False, False, False]


def test_reports_of_ordinary_reviews_move_their_rows_once(spark):
    """Ordinary and long reviews have the same pages; the rows of ordinary ones are moved to their review and no further."""
    rows = [(i % 4 or None, None if i % 97 == 5 else i // 3 if i % 3 else i, f"f{i % 5}.py", i % 7, "x" if i % 4 else "y", "low" if i % 2 else "high", "ruff" if i % 3 else "ai",
             f"t{i}", "d", None if i % 5 else "s", "unknown_file" if i % 6 == 1 else None) for i in range(400)]
    checked = spark.createDataFrame(rows, "review_id long, idx long, file_path string, line_number int, category string, severity string, source string, title string, description string, suggestion string, reason string")
    jobs = spark.createDataFrame([(i, "completed") for i in (1, 2, 2, 3, 9)] + [(None, "failed")], "review_id long, status string")
    kinds = [R.build_reports(jobs, checked, page_size=7, whole=whole).schema.simpleString() for whole in (0, 10**6)]
    assert kinds[0] == kinds[1]
    once = spark.createDataFrame(list({row[:2]: row for row in rows}.values()), checked.schema)
    built = {whole: sorted(map(repr, R.build_reports(jobs, once, page_size=7, whole=whole).collect())) for whole in (0, 60, 10**6)}
    assert built[0] == built[60] == built[10**6] and len(built[0]) > 40
    plan = R.build_reports(jobs, checked, page_size=7)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"review_id#\d+L", key) for key in keys)


@pytest.mark.parametrize("raw, error, count", [
    (answer(BASE), None, 1), (answer(dict(reversed(BASE.items())), BASE), None, 2), (answer(), None, 0), (" " + answer(BASE) + "\n", None, 1),
    *[(answer({**BASE, key: value}, BASE), "ai_invalid_response", None) for key in ("title", "line_number", "source") for value in (None, True, 2.0, "", [], {})],
    *[(answer({k: v for k, v in BASE.items() if k != key}, BASE), "ai_invalid_response", None) for key in ("title", "line_number", "suggestion")],
    *[(answer(item, BASE), "ai_invalid_response", None) for item in (None, [], "x", {}, {**BASE, "a: STRING, b": "x"}, {**BASE, "line_number": 2**64})],
    *[(answer(*[None] * n), "ai_invalid_response", None) for n in (1, 2)], (answer(BASE, extra=1), "ai_invalid_response", None),
    *[(before + answer(BASE) + after, "ai_invalid_response", None)
      for before, after in (("", "]"), ("", "}"), ("", "],[1"), ("", '},{"v":2'), ("", ",1"), ("", " x"), ("[", ""), ("", answer(BASE)))],
    (answer(BASE).replace('"title"', '"title":"a","title"'), "ai_invalid_response", None), (answer(*[BASE] * 51), "ai_invalid_response", None)])
def test_answers_are_read_by_their_shape(spark, raw, error, count):
    given = spark.createDataFrame([(1, BASE["file_path"], raw, "STOP")], "review_id long, file_path string, raw string, finish_reason string")
    row = E.validate_model_responses(given, lookup(spark)).first()
    assert (row.error, row.findings_count) == (error, count)


def test_an_answer_is_parsed_once_and_its_types_are_told_at_once(spark):
    given = spark.createDataFrame([(1, "a.py", answer(BASE), "STOP")], "review_id long, file_path string, raw string, finish_reason string")
    plan = E.validate_model_responses(given.repartition(2), lookup(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("schemaOfVariant(") == 1 and plan.count("try_variant_get(") <= 2
