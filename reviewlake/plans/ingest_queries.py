"""Deliveries to jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signing import BLOCK, hmac_sha256_hex, stable_id
from ..operators import ingest as I
from ..sources import readers
from ..sources.folders import stored
from .fixtures import oracle, view
from .registry import query

SECRET = "fixture-secret"
_PAD = SECRET.encode().ljust(BLOCK, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()
_BASE_COLUMNS = ("delivery_id", "event_type", "seq")

# The oracle writes the keyed digest out and reads the JSON with its own functions.
_DIGEST = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(body_text))))"
_ID = ("sha256(CAST(length(repository_name) AS VARCHAR) || ':' || repository_name || '|' || "
       "CAST(length(CAST(pull_request_number AS VARCHAR)) AS VARCHAR) || ':' || CAST(pull_request_number AS VARCHAR) || '|' || "
       "CAST(length(head_sha) AS VARCHAR) || ':' || head_sha || '|')")

_SIGNED = f"""SELECT *, CASE WHEN seq % 31 = 2 THEN 'sha256=' || repeat('0', 64) WHEN seq % 83 = 1 THEN NULL
    ELSE 'sha256=' || {_DIGEST} END AS signature FROM landed"""
_TYPED = """SELECT seq, received_at, value, body_text, signature, trim(delivery_id) AS delivery_id, trim(event_type) AS event_type,
    coalesce(signature = 'sha256=' || """ + _DIGEST + """, false) AS authentic,
    length(trim(delivery_id)) BETWEEN 1 AND 255 AND length(trim(event_type)) BETWEEN 1 AND 100 AS headers_ok,
    CASE WHEN json_valid(body_text) THEN json_type(body_text) = 'OBJECT' ELSE false END AS body_ok,
    CASE WHEN json_valid(body_text) THEN body_text ELSE '{}' END AS doc FROM signed"""
_FIELDS = r"""SELECT *,
    CASE WHEN json_type(doc, '$.action') = 'VARCHAR' THEN substr(json_extract_string(doc, '$.action'), 1, 100) END AS action,
    CASE WHEN json_type(doc, '$.repository.id') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(doc, '$.repository.id') AS BIGINT) END AS repository_id,
    CASE WHEN json_type(doc, '$.repository.full_name') = 'VARCHAR' THEN json_extract_string(doc, '$.repository.full_name') END AS repository_name,
    CASE WHEN json_type(doc, '$.pull_request.number') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(doc, '$.pull_request.number') AS BIGINT) END AS pull_request_number,
    CASE WHEN json_type(doc, '$.pull_request.head.sha') = 'VARCHAR' THEN json_extract_string(doc, '$.pull_request.head.sha') END AS head_sha,
    CASE WHEN json_type(doc, '$.pull_request.base.sha') = 'VARCHAR' THEN json_extract_string(doc, '$.pull_request.base.sha') END AS base_sha,
    coalesce(json_type(doc, '$.pull_request.base.sha'), 'NULL') AS base_type,
    CASE WHEN json_type(doc, '$.installation.id') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(doc, '$.installation.id') AS BIGINT) END AS installation_id
    FROM typed"""
_PREPARED = """SELECT *, coalesce(event_type = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened'), false) AS handled,
    coalesce(repository_id > 0 AND pull_request_number > 0 AND installation_id > 0 AND length(repository_name) BETWEEN 1 AND 255
      AND regexp_full_match(head_sha, '[0-9a-fA-F]{40}'), false)
      AND (base_type = 'NULL' OR coalesce(regexp_full_match(base_sha, '[0-9a-fA-F]{40}'), false)) AS target_ok FROM fields"""
_JUDGED = """SELECT *, CASE WHEN NOT authentic THEN 'signature' WHEN NOT body_ok THEN 'body' WHEN NOT headers_ok THEN 'headers'
    WHEN handled AND NOT target_ok THEN 'target' END AS reason FROM prepared"""
_FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY received_at, seq) AS arrival
    FROM judged WHERE reason IS NULL) WHERE arrival = 1"""
_CTES = dict(signed=_SIGNED, typed=_TYPED, fields=_FIELDS, prepared=_PREPARED, judged=_JUDGED, firsts=_FIRST)


def _sql(text: str, **more: str) -> str:
    return oracle(text, **_CTES, **more)


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_rows(view(spark, sf_dir, "landed"))


def signed_rows(landed: DataFrame) -> DataFrame:
    """Landed deliveries with their signature header; a few are forged or missing."""
    landed = landed.withColumn("body", F.col("body_text").cast("binary"))
    real = F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), SECRET))
    header = (F.when(F.col("seq") % 31 == 2, F.lit("sha256=" + "0" * 64))
              .when(F.col("seq") % 83 == 1, F.lit(None)).otherwise(real))
    return landed.withColumn("signature", header)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.prepare(signed(spark, sf_dir).drop("body_text"), SECRET)


def landed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked deliveries as a table, for queries that read them several times."""
    return stored(prepared(spark, sf_dir), "deliveries")


@query("ingest_verify_signature", "OP-I1", sql=_sql(
    f"SELECT seq, authentic, {_DIGEST} AS digest FROM typed"))
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = I.verify_signature(signed(spark, sf_dir), SECRET)
    return checked.select("seq", "authentic", hmac_sha256_hex(F.col("body"), SECRET).alias("digest"))


@query("ingest_check_headers", "OP-I2", sql=_sql("SELECT seq, delivery_id, event_type, headers_ok FROM typed"))
def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.check_headers(view(spark, sf_dir, "landed")).select(*_BASE_COLUMNS, "headers_ok")


@query("ingest_parse_body", "OP-I3", sql=_sql("SELECT seq, body_ok FROM typed"))
def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.parse_body(signed(spark, sf_dir)).select("seq", "body_ok")


@query("ingest_classify", "OP-I4", sql=_sql("SELECT seq, event_type, action, handled FROM prepared"))
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("seq", "event_type", "action", "handled")


@query("ingest_extract_target", "OP-I5", sql=_sql(
    """SELECT seq, repository_id, repository_name, pull_request_number, head_sha, base_sha, installation_id, target_ok
       FROM prepared"""))
def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(
        "seq", "repository_id", "repository_name", "pull_request_number", "head_sha", "base_sha", "installation_id",
        "target_ok")


@query("ingest_dedup", "OP-I6", headline=True, sql=_sql("SELECT delivery_id, seq, action FROM firsts"))
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dedup_deliveries(prepared(spark, sf_dir)).select("delivery_id", "seq", "action")


@query("ingest_jobs", "OP-I7", headline=True, sql=_sql(
    f"""SELECT {_ID} AS review_id, repository_name, pull_request_number, head_sha,
          arg_min(installation_id, (received_at, seq)) AS installation_id,
          arg_min(delivery_id, (received_at, seq)) AS created_by, count(*) AS deliveries
        FROM firsts WHERE handled GROUP BY ALL"""))
def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, links = I.deliveries_to_jobs(I.dedup_deliveries(landed_table(spark, sf_dir)))
    counts = links.groupBy("review_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return jobs.join(counts, "review_id").select(
        "review_id", *I.JOB_KEY, "installation_id", "created_by", "deliveries")


@query("ingest_links", "OP-I7", sql=_sql(f"SELECT delivery_id, {_ID} AS review_id FROM firsts WHERE handled"))
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.deliveries_to_jobs(I.dedup_deliveries(prepared(spark, sf_dir)))[1]


@query("ingest_disposition", "OP-I8", "OP-I6", headline=True, sql=_sql(
    """SELECT seq, reason, disposition, CASE disposition WHEN 'accepted' THEN 202 WHEN 'unauthenticated' THEN 401
         WHEN 'invalid' THEN 400 ELSE 200 END AS label
       FROM (SELECT j.seq, j.reason, CASE WHEN j.reason = 'signature' THEN 'unauthenticated' WHEN j.reason IS NOT NULL THEN 'invalid'
               WHEN f.seq IS NULL THEN 'duplicate' WHEN NOT j.handled THEN 'ignored' ELSE 'accepted' END AS disposition
             FROM judged j LEFT JOIN firsts f ON f.delivery_id = j.delivery_id AND f.seq = j.seq)"""))
def _disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.delivery_disposition(landed_table(spark, sf_dir)).select("seq", "reason", "disposition", "label")


@query("ingest_pending_redeliveries", "OP-I9", sql=_sql(
    f"""SELECT j.seq, j.delivery_id, s.review_id FROM judged j
        JOIN (SELECT delivery_id, seq, {_ID} AS review_id FROM firsts WHERE handled AND value > 60) s
          ON s.delivery_id = j.delivery_id AND s.seq < j.seq WHERE j.reason IS NULL"""))
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored state holds the first arrivals; some of their jobs were never queued.
    rows = landed_table(spark, sf_dir)
    state = I.job_id(I.dedup_deliveries(rows).filter("handled")).select(
        "delivery_id", "review_id", F.col("seq").alias("stored_seq"),
        F.when(F.col("value") > 60, "pending").otherwise("enqueued").alias("status"))
    again = rows.join(state.select("delivery_id", "stored_seq"), "delivery_id").filter("seq > stored_seq")
    return I.pending_redeliveries(again, state).select("seq", "delivery_id", "review_id")


_MANUAL = """SELECT id AS seq, repository_name, pull_request_number, md5(CAST(pull_request_number AS VARCHAR)) AS head_sha,
    status IN ('completed', 'failed', 'superseded') AS stored FROM review_jobs"""


@query("ingest_insert_new", "OP-I10", sql=oracle(
    """SELECT seq, CASE WHEN known IS NULL AND rn = 1 THEN 'inserted' ELSE 'conflict' END AS result FROM (
         SELECT i.seq, e.repository_name AS known,
                row_number() OVER (PARTITION BY i.repository_name, i.pull_request_number, i.head_sha ORDER BY i.seq) AS rn
         FROM manual i LEFT JOIN (SELECT DISTINCT repository_name, pull_request_number, head_sha FROM manual WHERE stored) e
           USING (repository_name, pull_request_number, head_sha) WHERE NOT i.stored)""", manual=_MANUAL))
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "review_jobs").select(
        F.col("id").alias("seq"), "repository_name", "pull_request_number",
        F.md5(F.col("pull_request_number").cast("string")).alias("head_sha"),
        F.col("status").isin("completed", "failed", "superseded").alias("stored"))
    existing, incoming = rows.filter("stored"), rows.filter("NOT stored").filter(I.manual_ok())
    inserted, conflicts = I.insert_new(existing, incoming)
    return (inserted.select("seq", F.lit("inserted").alias("result"))
            .unionByName(conflicts.select("seq", F.lit("conflict").alias("result"))))


@query("source_decoded_files", "OP-S3", sql=oracle(
    """SELECT doc_id, length(text) AS chars, sha256(text) AS digest, CASE WHEN text LIKE chr(65279) || '%' THEN 'utf-8-sig' ELSE 'utf-8' END
         AS encoding, CAST(NULL AS VARCHAR) AS skip_reason FROM documents"""))
def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = view(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("content"))
    decoded = readers.decode_sources(landed)
    return decoded.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"),
                          "encoding", "skip_reason")


@query("source_changed_files", "OP-S2", sql=oracle(
    """SELECT review_id, bad_rows > 0 AS failed, files, bad_rows FROM (SELECT review_id, count(*) AS files,
         count(*) FILTER (WHERE doc_id % 97 = 5) AS bad_rows FROM changed_files GROUP BY review_id)"""))
def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "changed_files").select(
        "review_id", "filename", "status", F.col("new_line_count").cast("string").alias("additions"),
        F.when(F.col("doc_id") % 97 == 5, "-1").otherwise("0").alias("deletions"),
        F.col("new_line_count").cast("string").alias("changes"), "patch")
    return readers.snapshot_status(readers.check_changed_files(raw))


@query("source_tool_output", "OP-S4", "OP-E1", sql=oracle(
    """SELECT review_id, idx, file_path, line_number, source, category, severity, title, description, suggestion FROM (
         SELECT review_id, idx, file_path, line_number, 'ruff' AS source, CASE WHEN category = 'security' THEN 'invalid-syntax' ELSE category END AS category,
           CASE WHEN category = 'security' THEN 'medium' ELSE 'low' END AS severity,
           'Ruff ' || CASE WHEN category = 'security' THEN 'invalid-syntax' ELSE category END AS title, description, suggestion
         FROM raw_findings WHERE source = 'ruff'
         UNION ALL
         SELECT review_id, idx, file_path, line_number, 'bandit', category, severity, title, description, NULL
         FROM raw_findings WHERE source = 'bandit')"""))
def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both analysers' JSON, written from the findings and read back into one shape."""
    rows = view(spark, sf_dir, "raw_findings")
    ruff = rows.filter("source = 'ruff'").select("review_id", "idx", F.to_json(F.array(F.struct(
        F.col("file_path").alias("filename"), F.when(F.col("category") != "security", F.col("category")).alias("code"),
        F.col("description").alias("message"), F.struct(F.col("line_number").alias("row")).alias("location"),
        F.when(F.col("suggestion").isNotNull(), F.struct(F.col("suggestion").alias("message"))).alias("fix")))).alias("raw"))
    bandit = rows.filter("source = 'bandit'").select("review_id", "idx", F.to_json(F.struct(
        F.array().cast("array<struct<filename:string,reason:string>>").alias("errors"),
        F.array(F.struct(F.col("file_path").alias("filename"), "line_number", F.col("category").alias("test_id"),
                         F.upper("severity").alias("issue_severity"), F.col("title").alias("test_name"),
                         F.col("description").alias("issue_text"))).alias("results"))).alias("raw"))
    from ..operators.findings import normalize_bandit, normalize_ruff

    keys = ("review_id", "idx")
    first = normalize_ruff(readers.read_tool_output(ruff, "ruff", keys).drop("pos", "bad"))
    second = normalize_bandit(readers.read_tool_output(bandit, "bandit", keys).drop("pos", "bad"))
    return first.unionByName(second).select(
        "review_id", "idx", "file_path", "line_number", "source", "category", "severity", "title", "description", "suggestion")


@query("source_model_responses", "OP-S5", sql=oracle(
    """SELECT review_id, idx, finish_reason, raw, CAST(prompt_tokens AS BIGINT) AS prompt_tokens,
         CAST(candidate_tokens AS BIGINT) AS candidate_tokens FROM model_responses"""))
def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with a thought and the answer cut into two parts, read back."""
    part = lambda text, thought: F.struct(text.alias("text"), F.lit(thought).alias("thought"))
    half = F.floor(F.length("raw") / 2).cast("int")
    parts = F.array(part(F.lit("thinking"), True), part(F.substring("raw", F.lit(1), half), False),
                    part(F.substring("raw", half + 1, F.length("raw")), False))
    landed = view(spark, sf_dir, "model_responses").select("review_id", "idx", F.to_json(F.struct(
        F.array(F.struct(F.col("finish_reason").alias("finishReason"), F.struct(parts.alias("parts")).alias("content")))
        .alias("candidates"),
        F.struct(F.col("prompt_tokens").alias("promptTokenCount"),
                 F.col("candidate_tokens").alias("candidatesTokenCount")).alias("usageMetadata"))).alias("response"))
    return readers.read_model_responses(landed).select(
        "review_id", "idx", "finish_reason", "raw", "prompt_tokens", "candidate_tokens")
