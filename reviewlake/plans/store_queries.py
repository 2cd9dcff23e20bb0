"""What is written and read back: labelled cases, replaced findings, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder, stored
from ..sources.manifest import Files
from ..sources.readers import read_cases
from ..sources.writers import read_findings, write_findings, write_json
from .fixtures import oracle, view
from .registry import query


def case_folders(spark: SparkSession, sf_dir: str) -> str:
    """One folder per labelled case with its ``labels.json``, as a dataset would come.

    Spark writes a file per case; only its name is changed afterwards. The number of cases is fixed by the
    view, so this loop does not grow with the tables.
    """
    root = shared_folder(spark, "cases")
    entry = F.struct("category", "file", "line")
    labels = view(spark, sf_dir, "expected_labels").groupBy(F.regexp_replace("case_id", "^case", "").alias("number")).agg(
        F.collect_list(entry).alias("expected"))  # the labels of one case are one document
    document = F.to_json(F.struct(F.concat(F.lit("case_"), "number").alias("case_id"), F.lit("generated").alias("category"),
                                  F.lit("app.py").alias("file"), F.lit("none").alias("contract"), "expected"))
    labels.select(F.col("number").alias("case_"), document.alias("value")).write.partitionBy("case_").text(root)
    files = Files(spark, root)
    for folder in files.names(""):
        if folder.startswith("case_="):
            (name,) = [n for n in files.names(folder) if n.startswith("part-")]
            files.move(f"{folder}/{name}", f"case_{folder.partition('=')[2]}/labels.json")
    return root


@query("source_cases", "OP-S6", sql=oracle("SELECT replace(case_id, 'case', 'case_') AS case_id, file, line, category FROM expected_labels"))
def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, expected = read_cases(spark, case_folders(spark, sf_dir))
    return expected


_ROWS = "SELECT review_id, idx, file_path, line_number, title FROM raw_findings"


@query("sink_replace_findings", "OP-S7", sql=oracle(
    f"""SELECT * FROM ({_ROWS}) WHERE review_id % 3 <> 0
        UNION ALL SELECT review_id, idx, file_path, line_number, 'again ' || title FROM ({_ROWS}) WHERE review_id % 3 = 0 AND review_id % 9 <> 0"""))
def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "findings")
    # All three calls read these rows; the view numbers and shuffles them, so it is evaluated once.
    first = stored(view(spark, sf_dir, "raw_findings").select("review_id", "idx", "file_path", "line_number", "title"), "raw-findings")
    write_findings(first, first.select("review_id"), path, buckets=16)
    # Every third review is analysed again, and every ninth then has no finding; the rows handed over also hold strays.
    named = first.filter("review_id % 3 = 0").select("review_id")
    fresh = first.filter("review_id % 9 <> 0 AND review_id % 5 <> 4 OR review_id % 3 = 0 AND review_id % 9 <> 0").withColumn("title", F.concat(F.lit("again "), "title"))
    for _ in range(2):  # the second time as a retry would
        write_findings(fresh, named, path, buckets=16)
    return read_findings(spark, path)


@query("sink_json_documents", "OP-S8", sql=oracle(
    """SELECT id AS review_id, status, started_at IS NULL AS waiting, CAST(attempt_count AS INTEGER) AS attempt_count, repository_name || '#' || CAST(pull_request_number AS VARCHAR) AS target
       FROM review_jobs"""))
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "documents")
    rows = view(spark, sf_dir, "review_jobs").select(
        F.col("id").alias("review_id"), "status", "started_at", "attempt_count", F.concat("repository_name", F.lit("#"), "pull_request_number").alias("target"))
    write_json(rows, path)
    lines = spark.read.text(path)
    # A missing value is written as null, so every document has all its keys.
    parsed = lines.select(F.from_json("value", "review_id long, status string, started_at string, attempt_count int, target string").alias("d"),
                          F.json_object_keys("value").alias("keys"))
    whole = F.sort_array("keys") == F.sort_array(F.array(*[F.lit(c) for c in rows.columns]))
    return parsed.filter(whole).select("d.review_id", "d.status", F.col("d.started_at").isNull().alias("waiting"), "d.attempt_count", "d.target")
