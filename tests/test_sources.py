"""Readers and writers on folders."""

import base64
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import evaluate as K
from reviewlake.operators import findings as E
from reviewlake.schemas import DELIVERY
from reviewlake.sources import readers, writers
from reviewlake.sources.folders import shared_folder
from reviewlake.sources.manifest import MOST_FOLDERS, BucketTable, Files


def test_deliveries_are_read_with_the_given_schema(spark, tmp_path):
    path = str(tmp_path / "landed")
    spark.createDataFrame([("d", "ping", None, bytearray(b"{}"), None, 1)], DELIVERY).write.parquet(path)
    assert readers.read_deliveries(spark, path).schema == DELIVERY
    assert readers.read_deliveries(spark, path, streaming=True).isStreaming


def test_one_bad_row_fails_the_snapshot(spark, tmp_path):
    rows = [dict(review_id=1, filename="a.py", status="added", additions=1, deletions=0, changes=1, patch="x"),
            dict(review_id=1, filename="b.py", status="added", additions=-1, deletions=0, changes=1),
            dict(review_id=2, filename="a.py", status="added", additions=1, deletions=0, changes=1),
            dict(review_id=3, filename="", status="added", additions=1, deletions=0, changes=1)]
    (tmp_path / "files.json").write_text("\n".join(map(json.dumps, rows)))
    files = readers.read_changed_files(spark, str(tmp_path / "files.json"))
    status = {r.review_id: (r.failed, r.files) for r in readers.snapshot_status(files).collect()}
    assert status == {1: (True, 2), 2: (False, 1), 3: (True, 1)}


def test_decoding(spark):
    contents = {"plain": "é".encode(), "mark": b"\xef\xbb\xbfx = 1", "latin": "é".encode("latin-1"), "cookie": b"# -*- coding: latin-1 -*-\n",
                "second": b"#!/bin/x\n# coding=utf-8\ny", "third": b"\n\n# coding: latin-1\n", "empty": b""}
    frame = spark.createDataFrame([(k, base64.encodebytes(v).decode()) for k, v in contents.items()], "name string, content string")
    frame = frame.unionByName(spark.createDataFrame([("broken", "***")], frame.schema))
    got = {r.name: (r.text, r.encoding, r.skip_reason) for r in readers.decode_sources(frame).collect()}
    refused = (None, None, "ai_source_encoding")
    assert got == {"plain": ("é", "utf-8", None), "mark": ("x = 1", "utf-8-sig", None), "latin": refused, "cookie": refused,
                   "second": (contents["second"].decode(), "utf-8", None), "third": (contents["third"].decode(), "utf-8", None),
                   "empty": ("", "utf-8", None), "broken": refused}


def test_malformed_tool_rows_are_marked(spark):
    issue = dict(filename="a.py", code="F401", message="m", location={"row": 3}, fix={"message": "f"})
    outputs = [(1, json.dumps([issue, {**issue, "code": None, "fix": None}])), (2, json.dumps([{**issue, "location": {"row": True}}])),
               (3, "not json"), (4, "[]"), (5, "{}")]
    frame = spark.createDataFrame(outputs, "review_id long, raw string")
    rows = readers.read_tool_output(frame, "ruff").orderBy("review_id", "pos").collect()
    assert [(r.review_id, r.bad) for r in rows] == [(1, False), (1, False), (2, True), (3, True), (5, True)]
    shaped = E.normalize_ruff(readers.read_tool_output(frame, "ruff").filter("NOT bad").drop("pos", "bad")).orderBy("category").collect()
    assert [(r.category, r.severity, r.suggestion) for r in shaped] == [("F401", "low", "f"), ("invalid-syntax", "medium", None)]
    broken = {"results": [], "errors": [{"filename": "a.py", "reason": "syntax error"}]}
    errors = readers.read_tool_errors(spark.createDataFrame([(1, json.dumps(broken))], "review_id long, raw string"))
    assert errors.collect() == [(1, "a.py", "syntax error")]


def test_labelled_cases(spark, tmp_path):
    for number in (1, 2):
        folder = tmp_path / f"case_00{number}"
        folder.mkdir()
        labels = {"case_id": folder.name, "category": "x", "file": "app/e.py", "contract": "c",
                  "expected": [{"category": "correctness", "file": "app/e.py", "line": 2}] if number == 1 else []}
        (folder / "labels.json").write_text(json.dumps(labels, indent=1))
        (folder / "after.py").write_text("x = 1\n")
        (folder / "patch.diff").write_text("@@ -0,0 +1 @@\n+x = 1\n")
    files, expected = readers.read_cases(spark, str(tmp_path))
    assert expected.collect() == [("case_001", "app/e.py", 2, "correctness")]
    assert files.count() == 6
    named = files.withColumn("name", F.concat_ws("/", "case_id", "name"))
    assert K.dataset_fingerprint(named, "name", "content").first().files == 6


def test_findings_are_replaced_per_review(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda *pairs: spark.createDataFrame(pairs, "review_id long, title string")
    table = lambda: sorted((r.review_id, r.title) for r in writers.read_findings(spark, path).collect())
    first = rows((1, "a"), (1, "b"), (2, "c"), (3, "d"))
    writers.write_findings(first, first, path, buckets=2)
    for _ in range(2):  # a repeated run changes nothing
        writers.write_findings(rows((1, "x")), rows((1, ""), (3, "")), path, buckets=2)
        assert table() == [(1, "x"), (2, "c")]


def test_findings_of_a_review_nobody_named_are_not_written(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda *pairs: spark.createDataFrame(pairs, "review_id long, title string")
    first = rows((1, "a"), (2, "b"), (3, "c"), (4, "d"))
    writers.write_findings(first, first, path, buckets=2)
    writers.write_findings(rows((1, "new"), (2, "stray"), (9, "stray")), rows((1, "")), path, buckets=2)
    assert sorted((r.review_id, r.title) for r in writers.read_findings(spark, path).collect()) == [(1, "new"), (2, "b"), (3, "c"), (4, "d")]


def test_a_reader_sees_a_swap_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "findings")
    rows = lambda *pairs: spark.createDataFrame(pairs, "review_id long, title string")
    first = rows(*[(i, "old") for i in range(20)])
    writers.write_findings(first, first, path, buckets=4)
    planned = writers.read_findings(spark, path)
    with monkeypatch.context() as broken:
        broken.setattr(Files, "publish", lambda *a: False)
        with pytest.raises(RuntimeError):
            writers.write_findings(rows(*[(i, "new") for i in range(20)]), first, path, buckets=4)
    assert {r.title for r in writers.read_findings(spark, path).collect()} == {"old"}
    writers.write_findings(rows(*[(i, "new") for i in range(20)]), first, path, buckets=4)
    assert {r.title for r in planned.collect()} == {"old"}  # planned before the swap: its folders are still there
    assert {r.title for r in writers.read_findings(spark, path).collect()} == {"new"}


def test_emptied_buckets_lose_their_rows(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda *pairs: spark.createDataFrame(pairs, "review_id long, title string")
    many = rows(*[(i, f"t{i}") for i in range(40)])
    writers.write_findings(many, many, path)
    gone = many.filter("review_id % 3 = 0")
    for _ in range(2):
        writers.write_findings(gone.limit(0), gone, path)
        assert sorted(r.review_id for r in writers.read_findings(spark, path).collect()) == [i for i in range(40) if i % 3]
    with pytest.raises(ValueError):
        writers.write_findings(many, many, path, buckets=8)
    writers.write_findings(many, many.limit(0), path)
    assert writers.read_findings(spark, path).count() == 26


def test_replacing_writes_what_is_new_and_not_the_table(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda *pairs: spark.createDataFrame(pairs, "review_id long, title string")
    many = rows(*[(i % 40, f"t{i}") for i in range(400)], (None, "nobody's"))
    writers.write_findings(many, many, path, buckets=2)
    data = tmp_path / "findings" / "data"
    before = set(data.iterdir())
    writers.write_findings(rows((3, "x"), (4, "y"), (5, "stray")), rows((3, ""), (4, ""), (None, "")), path, buckets=2)
    assert sum(spark.read.parquet(str(folder)).count() for folder in set(data.iterdir()) - before) <= 2 + 3  # findings, names
    want = {i: sorted(f"t{j}" for j in range(i, 400, 40)) for i in range(40)} | {3: ["x"], 4: ["y"]}
    for k in range(12):  # further calls, some of which merge what has gathered
        writers.write_findings(rows((k, f"again {k}"), (20, f"last {k}")), rows((k, ""), (20, ""), (30, "")), path, buckets=2)
        want |= {k: [f"again {k}"], 20: [f"last {k}"], 30: []}
        found = {i: [] for i in range(40)}
        for r in writers.read_findings(spark, path).collect():
            found[r.review_id].append(r.title)
        assert {i: sorted(titles) for i, titles in found.items()} == want
        state = BucketTable(spark, path, ["review_id"]).state
        assert all(len(state[kind].get(b, [])) <= MOST_FOLDERS for kind in ("folders", "removed") for b in ("0", "1"))
    wider = spark.createDataFrame([(1, "w", 2)], "review_id long, title string, line int")
    writers.write_findings(wider, wider, path, buckets=2)
    assert {r.title: r.line for r in writers.read_findings(spark, path).collect() if r.review_id in (1, 3)} == {"w": 2, "again 3": None}


def test_only_a_missing_path_is_no_table(spark, tmp_path):
    assert writers.read_table(spark, str(tmp_path / "none")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        writers.read_table(spark, str(tmp_path / "empty"))


def test_json_documents_keep_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(1, None)], "review_id long, error string")
    writers.write_json(frame, path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"review_id": 1, "error": None}
    assert json.loads(writers.to_json_rows(frame).first().value) == {"review_id": 1, "error": None}


def test_stage_log_has_a_closed_set_of_fields(spark):
    event = spark.createDataFrame([(1, "o/r", 7, "a" * 40, "w", "started", 0.5, "token=secret", "private")],
                                  "review_id long, repository_name string, pull_request_number long, head_sha string, worker string, "
                                  "stage string, duration double, error string, body string")
    log = writers.stage_log(event)
    assert tuple(log.columns) == writers.LOG_FIELDS
    assert log.first().error == "processing_error"


def test_shared_folder_follows_the_setting():
    def session(setting, master):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)

    assert shared_folder(session("s3a://shared/state/", "yarn"), "x").startswith("s3a://shared/state/x-")
    assert shared_folder(session(None, "local[2]"), "x")
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"), "x")
