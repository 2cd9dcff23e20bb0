"""Findings: normalise, admit, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import findings as E
from ..operators.reviewer import review_files, rule_reviewer
from ..schemas import FINDING_COLUMNS, TOKEN_COUNTERS
from .fixtures import oracle, view
from .patch_queries import DIFF, RULES
from .registry import query

ROW_OK = """coalesce(line_number > 0 AND source IN ('ruff', 'bandit', 'ai') AND severity IN ('high', 'medium', 'low')
    AND length(file_path) BETWEEN 1 AND 1024 AND length(category) BETWEEN 1 AND 128 AND length(title) BETWEEN 1 AND 256
    AND length(description) BETWEEN 1 AND 4000 AND (suggestion IS NULL OR length(suggestion) <= 4000), false)"""

ADDED = "SELECT DISTINCT review_id, filename, new_line AS line FROM numbered WHERE kind = 'added'"
FILES = """SELECT c.review_id, c.filename, c.new_line_count AS line_count FROM changed_files c"""
JUDGED = f"""SELECT f.*, CASE WHEN NOT {ROW_OK} THEN 'invalid_schema' WHEN c.filename IS NULL THEN 'unknown_file'
      WHEN f.line_number > c.line_count THEN 'invalid_line_number' WHEN a.line IS NULL THEN 'outside_reviewed_changes' END AS reason
    FROM review_findings f LEFT JOIN files c ON c.review_id = f.review_id AND c.filename = f.file_path
    LEFT JOIN added a ON a.review_id = f.review_id AND a.filename = f.file_path AND a.line = f.line_number"""
LOCATED = {**DIFF, "added": ADDED, "files": FILES, "located": JUDGED}


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reviewed_files(view(spark, sf_dir, "changed_files").withColumn("line_count", F.col("new_line_count")))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.validate_findings(view(spark, sf_dir, "review_findings"), reviewed(spark, sf_dir))


def _ruff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_findings").filter("source = 'ruff'").select(
        "review_id", "idx", "file_path", "line_number", F.when(F.col("category") != "security", F.col("category")).alias("code"),
        F.col("description").alias("message"), F.col("suggestion").alias("fix_message"))


_RUFF = """SELECT review_id, idx, file_path, line_number, 'ruff' AS source, category, CASE WHEN category = 'invalid-syntax' THEN 'medium'
    ELSE 'low' END AS severity, 'Ruff ' || category AS title, description, suggestion
    FROM (SELECT * REPLACE (CASE WHEN category = 'security' THEN 'invalid-syntax' ELSE category END AS category)
          FROM raw_findings WHERE source = 'ruff')"""
_BANDIT = """SELECT review_id, idx, file_path, line_number, 'bandit' AS source, category, severity, title, description,
    CAST(NULL AS VARCHAR) AS suggestion FROM raw_findings WHERE source = 'bandit'"""


@query("finding_normalize_ruff", "OP-E1", sql=oracle(_RUFF))
def _normalize_ruff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.normalize_ruff(_ruff(spark, sf_dir)).select("review_id", "idx", *FINDING_COLUMNS)


@query("finding_normalize_bandit", "OP-E2", sql=oracle(_BANDIT))
def _normalize_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_findings").filter("source = 'bandit'").select(
        "review_id", "idx", "file_path", "line_number", F.col("category").alias("test_id"), F.col("title").alias("test_name"),
        F.col("description").alias("issue_text"), F.upper("severity").alias("issue_severity"))
    return E.normalize_bandit(rows).select("review_id", "idx", *FINDING_COLUMNS)


@query("finding_bandit_batch_status", "OP-E3", sql=oracle(
    """SELECT e.review_id, CASE WHEN bool_or(r.file_path IS NULL OR NOT contains(lower(e.reason), 'syntax')) THEN 'bandit_file_error' END AS status,
         count(*) AS errors
       FROM errs e LEFT JOIN (SELECT DISTINCT review_id, file_path FROM ruff WHERE category = 'invalid-syntax') r
         ON r.review_id = e.review_id AND r.file_path = e.file_path GROUP BY e.review_id""",
    ruff=_RUFF, errs="""SELECT review_id, file_path, CASE WHEN l_suppkey % 3 = 0 THEN 'exception' ELSE 'Syntax error while parsing' END AS reason
        FROM raw_findings WHERE source = 'bandit' AND severity = 'critical' UNION ALL
        SELECT review_id, file_path, 'SYNTAX' FROM raw_findings WHERE source = 'ruff' AND category = 'security'"""))
def _bandit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_findings")
    errors = rows.filter("source = 'bandit' AND severity = 'critical'").select(
        "review_id", "file_path", F.when(F.col("l_suppkey") % 3 == 0, "exception")
        .otherwise("Syntax error while parsing").alias("reason")).unionByName(
        rows.filter("source = 'ruff' AND category = 'security'").select("review_id", "file_path", F.lit("SYNTAX").alias("reason")))
    return E.bandit_batch_status(errors, E.normalize_ruff(_ruff(spark, sf_dir)))


@query("finding_on_changed_lines", "OP-E5", headline=True, sql=oracle(
    """SELECT f.review_id, f.idx, f.file_path, f.line_number, f.source, f.category FROM review_findings f
       JOIN added a ON a.review_id = f.review_id AND a.filename = f.file_path AND a.line = f.line_number""", **DIFF, added=ADDED))
def _on_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = D.added_lines(view(spark, sf_dir, "changed_files"))
    kept = E.on_changed_lines(view(spark, sf_dir, "review_findings"), changed)
    return kept.select("review_id", "idx", "file_path", "line_number", "source", "category")


_STATIC = """SELECT review_id, bool_or(NOT coalesce(line_number > 0 AND severity IN ('high', 'medium', 'low'), false)) AS failed, count(*) AS rows
    FROM raw_findings WHERE source IN ('ruff', 'bandit') GROUP BY review_id"""


@query("finding_static_status", "OP-E6", sql=oracle(_STATIC))
def _static_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.static_status(view(spark, sf_dir, "raw_findings"))


@query("finding_void_failed", "OP-E6", sql=oracle(
    """SELECT review_id, idx, source FROM raw_findings r WHERE source = 'ai'
       OR NOT EXISTS (SELECT 1 FROM static s WHERE s.review_id = r.review_id AND s.failed)""", static=_STATIC))
def _void(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_findings")
    return E.void_failed(rows, E.static_status(rows)).select("review_id", "idx", "source")


_ENVELOPE = """SELECT *, CASE WHEN finish_reason <> 'STOP' THEN 'ai_incomplete_response' WHEN NOT json_valid(raw) THEN 'invalid_json'
    WHEN NOT coalesce(json_keys(raw) = ['findings'] AND json_type(raw, '$.findings') = 'ARRAY', false) THEN 'invalid_response_envelope' END AS envelope_error
    FROM model_responses"""


@query("finding_check_envelope", "OP-E7", sql=oracle("SELECT review_id, idx, envelope_error FROM enveloped", enveloped=_ENVELOPE))
def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.check_envelope(view(spark, sf_dir, "model_responses")).select("review_id", "idx", "envelope_error")


_ITEM = """SELECT review_id, idx, json_extract(raw, '$.findings[0]') AS item FROM enveloped
    WHERE envelope_error IS NULL AND json_array_length(raw, '$.findings') > 0"""
_STRICT = """SELECT review_id, idx, item,
    CASE WHEN json_type(item, '$.line_number') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(item, '$.line_number') AS INTEGER) END AS line_number,
    coalesce(len(json_keys(item)) = 8 AND json_type(item, '$.line_number') IN ('UBIGINT', 'BIGINT')
      AND CAST(json_extract_string(item, '$.line_number') AS VARCHAR) <> '0'
      AND json_extract_string(item, '$.severity') IN ('high', 'medium', 'low') AND json_type(item, '$.description') = 'VARCHAR', false) AS row_fine,
    json_type(item, '$.suggestion') AS suggestion_type FROM items"""


@query("finding_strict_schema", "OP-E8", headline=True, sql=oracle(
    """SELECT review_id, idx, line_number, row_fine AS schema_ok, row_fine AND suggestion_type = 'VARCHAR' AS ai_schema_ok FROM strict""",
    enveloped=_ENVELOPE, items=_ITEM, strict=_STRICT))
def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = E.explode_items(E.check_envelope(view(spark, sf_dir, "model_responses")), ("review_id", "idx"))
    general = E.strict_schema(items)
    return general.select("review_id", "idx", "line_number", "schema_ok", "ai_schema_ok")


@query("finding_strict_rows", "OP-E8", sql=oracle(f"SELECT review_id, idx, {ROW_OK} AS schema_ok FROM raw_findings"))
def _strict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strict_rows(view(spark, sf_dir, "raw_findings")).select("review_id", "idx", "schema_ok")


@query("finding_validate_locations", "OP-E9", headline=True, sql=oracle("SELECT review_id, idx, reason FROM located", **LOCATED))
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("review_id", "idx", "reason")


_ANSWERED = """SELECT r.review_id, r.idx, CASE WHEN r.finish_reason <> 'STOP' THEN 'ai_incomplete_response'
      WHEN NOT json_valid(r.raw) THEN 'ai_invalid_response' WHEN f.line_number <= 0 OR f.severity = 'critical' THEN 'ai_invalid_response'
      WHEN f.source = 'ruff' OR r.idx % 23 = 0 OR a.line IS NULL OR one.line IS NULL OR f.line_number > c.line_count OR c.line_count < 1
        THEN 'ai_invalid_location' END AS error
    FROM file_responses r JOIN review_findings f ON f.review_id = r.review_id AND f.idx = r.idx
    LEFT JOIN files c ON c.review_id = f.review_id AND c.filename = f.file_path
    LEFT JOIN added a ON a.review_id = f.review_id AND a.filename = f.file_path AND a.line = f.line_number
    LEFT JOIN added one ON one.review_id = f.review_id AND one.filename = f.file_path AND one.line = 1"""


@query("finding_validate_model_responses", "OP-E10", sql=oracle(
    "SELECT review_id, idx, error, CASE WHEN error IS NULL THEN 2 END AS findings_count FROM answered",
    **{k: v for k, v in LOCATED.items() if k != "located"}, answered=_ANSWERED))
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = E.validate_model_responses(view(spark, sf_dir, "file_responses"), reviewed(spark, sf_dir))
    return checked.select("review_id", "idx", "error", "findings_count")


@query("finding_usage", "OP-E13", sql=oracle(
    "SELECT review_id, count(*) AS calls, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKEN_COUNTERS) + " FROM model_responses GROUP BY review_id"))
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.usage(view(spark, sf_dir, "model_responses"), ["review_id"], TOKEN_COUNTERS)


# Each answer with the error its call ended with, if any.
_CALLS = """SELECT review_id, idx, review_id % 17 <> 4 AS encoding_ok, CASE WHEN finish_reason <> 'STOP' THEN 'ai_incomplete_response'
    WHEN review_id % 13 = 0 THEN 'ai_http_503' WHEN review_id % 13 = 1 THEN 'ai_file_limit' WHEN review_id % 13 = 2 THEN 'ai_total_input_limit'
    WHEN review_id % 13 = 4 THEN 'ai_transport_error' WHEN review_id % 13 = 5 THEN 'ai_http_401' END AS error FROM model_responses"""
_OUTCOMES = """SELECT *, CASE WHEN NOT encoding_ok OR coalesce(error IN ('ai_diff_limit', 'ai_file_limit', 'ai_total_input_limit'), false) THEN 'skipped'
      WHEN error IS NOT NULL THEN 'failed' ELSE 'reviewed' END AS outcome,
    CASE WHEN NOT encoding_ok THEN 'ai_source_encoding' WHEN error IN ('ai_diff_limit', 'ai_file_limit', 'ai_total_input_limit') THEN error
      WHEN error IS NOT NULL THEN 'ai_review_failed' END AS outcome_reason,
    coalesce(encoding_ok AND error IN ('ai_transport_error', 'ai_http_408', 'ai_http_429', 'ai_http_500', 'ai_http_502', 'ai_http_503', 'ai_http_504'), false) AS retryable
    FROM calls"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.col("review_id")
    error = (F.when(F.col("finish_reason") != "STOP", "ai_incomplete_response").when(review % 13 == 0, "ai_http_503")
             .when(review % 13 == 1, "ai_file_limit").when(review % 13 == 2, "ai_total_input_limit")
             .when(review % 13 == 4, "ai_transport_error").when(review % 13 == 5, "ai_http_401"))
    return view(spark, sf_dir, "model_responses").select(
        "review_id", "idx", (review % 17 != 4).alias("encoding_ok"), error.alias("error"))


@query("finding_file_outcomes", "OP-E14", sql=oracle(
    "SELECT review_id, idx, outcome, outcome_reason, retryable FROM outcomes", calls=_CALLS, outcomes=_OUTCOMES))
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.file_outcomes(_calls(spark, sf_dir)).select("review_id", "idx", "outcome", "outcome_reason", "retryable")


_HTTP = """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ai' ELSE 'github' END AS service, k,
    CASE WHEN k < 5 THEN NULL WHEN k < 40 THEN 200 WHEN k < 50 THEN 403 WHEN k < 60 THEN 429 WHEN k < 70 THEN 503 WHEN k < 75 THEN 408
         WHEN k < 80 THEN 501 WHEN k < 90 THEN 404 ELSE 401 END AS http_status,
    CASE WHEN event_id % 3 = 0 THEN '0' WHEN event_id % 3 = 1 THEN '7' END AS rate_remaining,
    CASE WHEN event_id % 4 = 0 THEN CAST(1000 + k * 10 AS VARCHAR) WHEN event_id % 4 = 1 THEN 'soon' END AS rate_reset,
    CASE WHEN event_id % 5 = 0 THEN CAST(k * 2 AS VARCHAR) WHEN event_id % 5 = 1 THEN 'later' END AS retry_after_header,
    CASE WHEN event_id % 7 = 0 THEN 'API Rate Limit exceeded' ELSE 'no' END AS body FROM
    (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
_CLASSIFIED = """SELECT event_id, CASE WHEN http_status IS NULL AND service = 'ai' THEN 'ai_transport_error' WHEN http_status IS NULL THEN 'github_unavailable'
      WHEN service = 'ai' AND http_status <> 200 THEN 'ai_http_' || CAST(http_status AS VARCHAR)
      WHEN service = 'github' AND http_status >= 400 THEN 'github_http_' || CAST(http_status AS VARCHAR) END AS error,
    coalesce(CASE WHEN http_status IS NULL THEN true WHEN service = 'ai' THEN http_status IN (408, 429, 500, 502, 503, 504)
      ELSE http_status IN (408, 429) OR http_status >= 500 OR (http_status = 403 AND (coalesce(rate_remaining = '0', false)
        OR retry_after_header IS NOT NULL OR contains(lower(body), 'rate limit'))) END, false) AS retryable, service, http_status,
    greatest(60, coalesce(TRY_CAST(retry_after_header AS BIGINT), 60), coalesce(CASE WHEN rate_remaining = '0' AND (retry_after_header IS NULL
      OR TRY_CAST(retry_after_header AS BIGINT) IS NOT NULL) THEN TRY_CAST(coalesce(rate_reset, '0') AS BIGINT) - 1200 + 1 END, 60)) AS delay FROM http"""


@query("finding_classify_errors", "OP-E15", sql=oracle(
    """SELECT event_id, error, retryable, CAST(CASE WHEN retryable AND service = 'github' AND http_status IS NOT NULL THEN delay END AS BIGINT) AS retry_after
       FROM classified""", http=_HTTP, classified=_CLASSIFIED))
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, event = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id")
    calls = view(spark, sf_dir, "events").withColumn("k", k).select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "ai").otherwise("github").alias("service"),
        F.when(F.col("k") < 5, None).when(F.col("k") < 40, 200).when(F.col("k") < 50, 403).when(F.col("k") < 60, 429)
        .when(F.col("k") < 70, 503).when(F.col("k") < 75, 408).when(F.col("k") < 80, 501).when(F.col("k") < 90, 404)
        .otherwise(401).alias("http_status"),
        F.when(event % 3 == 0, "0").when(event % 3 == 1, "7").alias("rate_remaining"),
        F.when(event % 4 == 0, (1000 + F.col("k") * 10).cast("string")).when(event % 4 == 1, "soon").alias("rate_reset"),
        F.when(event % 5 == 0, (F.col("k") * 2).cast("string")).when(event % 5 == 1, "later").alias("retry_after_header"),
        F.when(event % 7 == 0, "API Rate Limit exceeded").otherwise("no").alias("body"), F.lit(1200).alias("now_epoch"))
    return E.classify_errors(calls).select("event_id", "error", "retryable", "retry_after")


@query("finding_component_status", "OP-E16", sql=oracle(
    """SELECT review_id, ai_status, retry_ai, CASE WHEN retry_ai THEN 'queued' WHEN static_failed OR ai_status = 'failed' THEN 'failed'
         ELSE 'completed' END AS final_status
       FROM (SELECT j.id AS review_id, coalesce(s.failed, false) AS static_failed,
               CASE WHEN j.id % 6 = 0 THEN 'disabled' WHEN coalesce(o.bad, 0) > 0 THEN 'failed' WHEN coalesce(o.skipped, 0) > 0 THEN 'limited'
                    ELSE 'completed' END AS ai_status,
               j.id % 6 <> 0 AND coalesce(o.transient, false) AND j.attempt_count < 4 AS retry_ai
             FROM review_jobs j LEFT JOIN static s ON s.review_id = j.id
             LEFT JOIN (SELECT review_id, count(*) FILTER (WHERE outcome = 'failed') AS bad, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
                          bool_or(retryable) AS transient FROM outcomes GROUP BY review_id) o ON o.review_id = j.id)""",
    calls=_CALLS, outcomes=_OUTCOMES, static=_STATIC))
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = E.file_outcomes(_calls(spark, sf_dir)).groupBy("review_id").agg(
        F.count(F.when(F.col("outcome") == "failed", 1)).alias("ai_failed"),
        F.count(F.when(F.col("outcome") == "skipped", 1)).alias("ai_skipped"), F.bool_or("retryable").alias("ai_transient"))
    static = E.static_status(view(spark, sf_dir, "raw_findings")).select("review_id", F.col("failed").alias("static_failed"))
    jobs = view(spark, sf_dir, "review_jobs").select(
        F.col("id").alias("review_id"), "attempt_count", (F.col("id") % 6 != 0).alias("ai_enabled"))
    joined = jobs.join(static, "review_id", "left").join(outcomes, "review_id", "left").fillna(
        {"static_failed": False, "ai_failed": 0, "ai_skipped": 0, "ai_transient": False})
    return E.component_status(joined).select("review_id", "ai_status", "retry_ai", "final_status")


_REVIEWED = "\nUNION ALL\n".join(
    f"""SELECT review_id, filename, CAST(new_line AS INTEGER) AS line_number, '{r.id}' AS category, '{r.severity}' AS severity FROM numbered
        WHERE kind = 'added' AND filename LIKE '%{r.suffix}' AND regexp_matches(text, '{r.pattern}')""" for r in RULES)


@query("finding_pluggable_reviewer", "OP-N1", sql=oracle(
    """SELECT c.review_id, c.filename, CASE WHEN e.error IS NULL THEN 'reviewed' ELSE 'failed' END AS outcome, e.error, false AS retryable,
         h.line_number, h.category, h.severity
       FROM changed_files c LEFT JOIN errors e ON e.review_id = c.review_id AND e.filename = c.filename
       LEFT JOIN hits h ON h.review_id = c.review_id AND h.filename = c.filename""", **DIFF, hits=_REVIEWED))
def _reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Added lines come from the diff operators; a file whose patch is unsound is refused before the reviewer sees it.
    files = view(spark, sf_dir, "changed_files").select("review_id", "filename", D.added_text(F.col("patch")).alias("added"),
                                                        D.parsed_patch(F.col("patch"))["error"].alias("refused"))
    rows = review_files(files, rule_reviewer(RULES))
    return rows.select("review_id", "filename", "outcome", "error", "retryable", "line_number", "category", "severity")
