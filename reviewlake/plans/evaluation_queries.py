"""Scoring against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as K
from .fixtures import oracle, view
from .registry import query

_NORMAL = """SELECT * REPLACE (CASE source WHEN 'bandit' THEN CASE WHEN category IN ('B110', 'B112') THEN 'correctness' ELSE 'security' END
    WHEN 'ruff' THEN CASE WHEN category IN ('F401', 'F841') THEN 'quality' ELSE 'correctness' END ELSE category END AS category)
    FROM experiment_findings"""
# Scoring by windows: the n-th finding of a key hits when the key has an n-th label.
_NUMBERED_FOUND = """SELECT *, row_number() OVER (PARTITION BY experiment, case_id, file_path, line_number, category ORDER BY seq) AS nth FROM normal"""
_NUMBERED_EXPECTED = """SELECT *, row_number() OVER (PARTITION BY case_id, file, line, category) AS nth FROM expected_labels"""
_SCORED = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / nullif(tp + fp, 0)::DOUBLE AS precision,
    tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.normalize_category(view(spark, sf_dir, "experiment_findings"))


@query("eval_normalize_category", "OP-K1", sql=oracle("SELECT seq, source, category FROM normal", normal=_NORMAL))
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("seq", "source", "category")


@query("eval_match_counts", "OP-K2", "OP-K3", headline=True, sql=oracle(
    f"""SELECT case_id, {_SCORED} FROM (
          SELECT coalesce(f.case_id, e.case_id) AS case_id, count(*) FILTER (WHERE f.nth IS NOT NULL AND e.nth IS NOT NULL) AS tp,
            count(*) FILTER (WHERE e.nth IS NULL) AS fp, count(*) FILTER (WHERE f.nth IS NULL) AS fn
          FROM (SELECT *, row_number() OVER (PARTITION BY case_id, file_path, line_number, category ORDER BY seq) AS nth FROM normal) f
          FULL JOIN expected e ON e.case_id = f.case_id AND e.file = f.file_path AND e.line = f.line_number AND e.category = f.category AND e.nth = f.nth
          GROUP BY 1)""", normal=_NORMAL, expected=_NUMBERED_EXPECTED))
def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = K.match_counts(view(spark, sf_dir, "expected_labels"), normal(spark, sf_dir), ["case_id"])
    return K.scores(counts)


@query("eval_dedup_first", "OP-K4", sql=oracle(
    """SELECT experiment, case_id, file_path, line_number, category, min(seq) AS seq FROM normal GROUP BY ALL""", normal=_NORMAL))
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedup_first(normal(spark, sf_dir), ["experiment", "case_id"]).select(
        "experiment", "case_id", "file_path", "line_number", "category", "seq")


@query("eval_combine", "OP-K5", sql=oracle(
    """SELECT case_id, file_path, line_number, category, arg_min(seq, (experiment, seq)) AS seq, min(experiment) AS experiment FROM normal
       WHERE experiment IN ('A', 'B') AND case_id IN (SELECT case_id FROM case_status WHERE experiment = 'B' AND status = 'completed') GROUP BY ALL""", normal=_NORMAL))
def _combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(spark, sf_dir).select("case_id", "file_path", "line_number", "category", "seq", "experiment")


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    completed = view(spark, sf_dir, "case_status").filter("experiment = 'B' AND status = 'completed'")
    return K.combine(rows.filter("experiment = 'A'"), rows.filter("experiment = 'B'"), completed)


@query("eval_blocked_status", "OP-K6", sql=oracle(
    """SELECT review_id, idx, CASE WHEN at_r IS NOT NULL AND (review_id, idx) > (at_r, at_i) THEN 'not_run' WHEN error IS NOT NULL THEN 'failed'
         ELSE 'completed' END AS run_status, CASE WHEN at_r IS NOT NULL AND (review_id, idx) > (at_r, at_i) THEN code ELSE error END AS run_reason
       FROM tries LEFT JOIN (SELECT review_id AS at_r, idx AS at_i, error AS code FROM tries WHERE error IS NOT NULL ORDER BY review_id, idx LIMIT 1) ON true""",
    tries="""SELECT review_id, idx, CASE WHEN finish_reason <> 'STOP' AND raw LIKE '%part 7%' THEN 'ai_incomplete_response' END AS error
             FROM model_responses"""))
def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = view(spark, sf_dir, "model_responses").select("review_id", "idx", F.when(
        (F.col("finish_reason") != "STOP") & F.col("raw").contains("part 7"), "ai_incomplete_response").alias("error"))
    return K.blocked_status(tries, ["review_id", "idx"]).select("review_id", "idx", "run_status", "run_reason")


@query("eval_experiment_summary", "OP-K7", "OP-K2", "OP-K3", headline=True, sql=oracle(
    f"""SELECT s.experiment, s.completed_cases, s.total_cases, {_SCORED} FROM
          (SELECT experiment, count(*) FILTER (WHERE status = 'completed') AS completed_cases, count(*) AS total_cases FROM case_status GROUP BY 1) s
          LEFT JOIN (SELECT coalesce(f.experiment, e.experiment) AS experiment, count(*) FILTER (WHERE f.nth IS NOT NULL AND e.nth IS NOT NULL) AS tp,
              count(*) FILTER (WHERE e.nth IS NULL) AS fp, count(*) FILTER (WHERE f.nth IS NULL) AS fn
            FROM (SELECT n.* FROM found n JOIN done d USING (experiment, case_id)) f
            FULL JOIN (SELECT d.experiment, x.* FROM expected x JOIN done d USING (case_id)) e ON e.experiment = f.experiment AND e.case_id = f.case_id
              AND e.file = f.file_path AND e.line = f.line_number AND e.category = f.category AND e.nth = f.nth GROUP BY 1) c ON c.experiment = s.experiment""",
    normal=_NORMAL, found=_NUMBERED_FOUND, expected=_NUMBERED_EXPECTED,
    done="SELECT experiment, case_id FROM case_status WHERE status = 'completed'"))
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.experiment_summary(view(spark, sf_dir, "expected_labels"), normal(spark, sf_dir), view(spark, sf_dir, "case_status"))


# The combined experiment beside the others: it ran where the second one completed.
_STATUSES = """SELECT experiment, case_id, status FROM case_status UNION ALL
    SELECT 'C', case_id, CASE WHEN status = 'completed' THEN 'completed' ELSE 'not_run' END FROM case_status WHERE experiment = 'B'"""
_BOTH = """SELECT experiment, case_id, file_path, line_number, category, seq FROM normal UNION ALL
    SELECT 'C', case_id, file_path, line_number, category, min(seq) FROM normal
    WHERE experiment IN ('A', 'B') AND case_id IN (SELECT case_id FROM case_status WHERE experiment = 'B' AND status = 'completed') GROUP BY ALL"""


@query("eval_all_experiments", "OP-K5", "OP-K7", sql=oracle(
    f"""SELECT s.experiment, s.completed_cases, s.total_cases, {_SCORED} FROM
          (SELECT experiment, count(*) FILTER (WHERE status = 'completed') AS completed_cases, count(*) AS total_cases FROM statuses GROUP BY 1) s
          LEFT JOIN (SELECT coalesce(f.experiment, e.experiment) AS experiment, count(*) FILTER (WHERE f.nth IS NOT NULL AND e.nth IS NOT NULL) AS tp,
              count(*) FILTER (WHERE e.nth IS NULL) AS fp, count(*) FILTER (WHERE f.nth IS NULL) AS fn
            FROM (SELECT n.* FROM found n JOIN done d USING (experiment, case_id)) f
            FULL JOIN (SELECT d.experiment, x.* FROM expected x JOIN done d USING (case_id)) e ON e.experiment = f.experiment AND e.case_id = f.case_id
              AND e.file = f.file_path AND e.line = f.line_number AND e.category = f.category AND e.nth = f.nth GROUP BY 1) c ON c.experiment = s.experiment""",
    normal=_NORMAL, statuses=_STATUSES, gathered=_BOTH, found=_NUMBERED_FOUND.replace("FROM normal", "FROM gathered"), expected=_NUMBERED_EXPECTED,
    done="SELECT experiment, case_id FROM statuses WHERE status = 'completed'"))
def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = view(spark, sf_dir, "case_status")
    third = status.filter("experiment = 'B'").select(
        F.lit("C").alias("experiment"), "case_id", F.when(F.col("status") == "completed", "completed").otherwise("not_run").alias("status"))
    columns = ["experiment", "case_id", "file_path", "line_number", "category"]
    found = normal(spark, sf_dir).select(*columns).unionByName(combined(spark, sf_dir).withColumn("experiment", F.lit("C")).select(*columns))
    return K.experiment_summary(view(spark, sf_dir, "expected_labels"), found, status.unionByName(third))


_WORDS = ", ".join(f"CAST(CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS w{i}" for i in range(K.WORDS))


@query("eval_dataset_fingerprint", "OP-K8", sql=oracle(
    f"""SELECT source, files, sha256(CAST(files AS VARCHAR) || ':' || concat_ws(',', {', '.join(f'w{i}' for i in range(K.WORDS))})) AS fingerprint
        FROM (SELECT source, count(*) AS files, {_WORDS} FROM (SELECT source, sha256(CAST(length(name) AS VARCHAR) || ':' || name || '|64:' || sha256(text) || '|') AS d
              FROM (SELECT source, text, 'doc' || CAST(doc_id AS VARCHAR) AS name FROM documents)) GROUP BY source)"""))
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = view(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").cast("binary").alias("content"))
    return K.dataset_fingerprint(documents, "name", "content", ["source"])
