"""What the plans of all registered queries must not contain."""

import re
from datetime import datetime

import pytest

from reviewlake.plans import fixtures
from reviewlake.plans.registry import load_all
from reviewlake.plans.fixtures import TABLES, view
from reviewlake.operators import findings as E
from reviewlake.operators import diff as D
from reviewlake.operators import serving as J

BATCH = {name: query for name, query in load_all().items() if not name.startswith("stream_")}
PYTHON = {"finding_pluggable_reviewer"}
# Its windows run over a histogram of a bounded number of buckets, not over rows.
UNPARTITIONED = {"stats_nearest_rank_overall", "stats_nearest_rank_epoch"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_python_cross_join_or_global_window(spark, sf_dir, name):
    plan = plan_of(BATCH[name].run(spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in PYTHON:
        assert "MapInPandas" not in plan
    if name not in UNPARTITIONED:
        assert not re.search(r"windowspecdefinition\((?:specified|[^,()]* (?:ASC|DESC))", plan)


def test_reading_is_narrow(spark, sf_dir):
    jobs = view(spark, sf_dir, "review_jobs")
    plan = plan_of(J.status_summary(jobs))
    assert re.search(r"ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>", plan)
    pushed = plan_of(jobs.filter("id = 5").select("id"))
    assert "EqualTo(o_orderkey,5)" in pushed


def test_diffs_need_no_shuffle(spark, sf_dir):
    files = view(spark, sf_dir, "changed_files").withColumnRenamed("new_line_count", "line_count")
    for frame in (D.changed_lines(files), D.diff_errors(files), D.hunks(files), E.reviewed_files(files)):
        assert "Exchange" not in plan_of(frame)


def test_a_page_is_a_top_k(spark, sf_dir):
    plan = plan_of(J.list_reviews(view(spark, sf_dir, "review_jobs"), 2, 20))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_findings_of_a_file_are_moved_once(spark, tmp_path):
    """Spark's form of the view has the rows of the view itself, also for repeated and missing keys, and moves source rows once."""
    lines = [(None if i % 31 == 4 else i % 90, i % 50, i % 20 if i % 13 else None, i % 7, float(i % 9), float(i), i % 5 / 50, i % 3 / 50, "ANR"[i % 3], "OF"[i % 2],
              datetime(1998, 1, 1 + i % 28)) for i in range(400)]
    names = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
             "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    spark.createDataFrame(lines + lines[:9], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i % 5, "a\nb") for i in range(6)] + [(None, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    paths = {table: f"parquet.`{tmp_path}/{table}.parquet`" for table in TABLES}
    plain, moved = spark.sql(fixtures._with("SELECT * FROM review_findings", paths)), fixtures.view(spark, str(tmp_path), "review_findings")
    assert moved.count() > 300 and sorted(map(repr, moved.collect())) == sorted(map(repr, plain.collect())) and moved.schema == plain.schema
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = [plan_of(spark.sql(fixtures._with("SELECT * FROM review_findings", paths, views=views))).count("hashpartitioning(")
                 for views in (fixtures.VIEWS, fixtures.SPARK_VIEWS)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moves == [3, 2]  # one of them is the files' own
