"""Scope and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import Limits
from ..operators import diff as D
from ..operators import findings as E
from ..operators import scope as C
from .fixtures import oracle, view
from .registry import query

LIMITS = Limits(max_files=6, max_patch_chars_per_file=2_000, max_total_patch_chars=6_000)

# --- oracle pieces -----------------------------------------------------------------------

_PARENTS = "list_filter(list_slice(string_split(lower(filename), '/'), 1, -2), lambda p: p <> '' AND p <> '.')"


def _reason(limits: Limits) -> str:
    dirs = ", ".join(f"'{d}'" for d in ("vendor", "vendored", "third_party", "third-party", "node_modules", ".venv", "venv", "__pycache__",
                                        "generated", "_generated", "build", "dist"))
    marks = " OR ".join(f"contains(lower(coalesce(patch, '')), '{m}')" for m in (
        "@generated", "automatically generated", "auto-generated", "autogenerated", "do not edit"))
    return f"""SELECT *, length(coalesce(patch, '')) AS patch_chars,
      CASE WHEN list_has_any({_PARENTS}, [{dirs}]) THEN 'ignored_directory'
           WHEN base LIKE '%.lock' OR base LIKE '%.lock.py' OR base IN ('poetry.lock', 'pipfile.lock') THEN 'lock_file'
           WHEN NOT regexp_matches(base, '.\\.py$') THEN 'unsupported_extension'
           WHEN regexp_matches(base, '(_pb2\\.py|_pb2_grpc\\.py|\\.generated\\.py)$') OR {marks} THEN 'generated_file'
           WHEN status = 'removed' THEN 'removed_file' WHEN coalesce(patch, '') = '' THEN 'missing_patch'
           WHEN contains(patch, chr(0)) OR patch LIKE 'Binary files %' OR patch LIKE 'GIT binary patch%' THEN 'binary_patch'
           WHEN length(patch) > {limits.max_patch_chars_per_file} THEN 'max_patch_chars_per_file' END AS reason
      FROM (SELECT *, string_split(lower(filename), '/')[-1] AS base FROM changed_files) AS f"""


_ORDERED = """SELECT review_id, filename, patch_chars, row_number() OVER (PARTITION BY review_id ORDER BY filename) AS k
    FROM scoped WHERE reason IS NULL"""
_WALK = f"""SELECT review_id, CAST(0 AS BIGINT) AS k, '' AS filename, 0 AS taken, CAST(0 AS BIGINT) AS total,
      CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS patch_chars FROM (SELECT DISTINCT review_id FROM ordered)
    UNION ALL
    SELECT o.review_id, o.k, o.filename,
      w.taken + CASE WHEN w.taken < {LIMITS.max_files} AND w.total + o.patch_chars <= {LIMITS.max_total_patch_chars} THEN 1 ELSE 0 END,
      w.total + CASE WHEN w.taken < {LIMITS.max_files} AND w.total + o.patch_chars <= {LIMITS.max_total_patch_chars} THEN o.patch_chars ELSE 0 END,
      CASE WHEN w.taken >= {LIMITS.max_files} THEN 'max_files'
           WHEN w.total + o.patch_chars > {LIMITS.max_total_patch_chars} THEN 'max_total_patch_chars' END, o.patch_chars
    FROM walk w JOIN ordered o ON o.review_id = w.review_id AND o.k = w.k + 1"""
_DECIDED = """SELECT review_id, filename, reason, patch_chars FROM scoped WHERE reason IS NOT NULL
    UNION ALL SELECT review_id, filename, reason, patch_chars FROM walk WHERE k > 0"""
_SCOPE = dict(scoped=_reason(LIMITS), ordered=_ORDERED, walk=_WALK, decided=_DECIDED)

_LINES = """SELECT review_id, filename, unnest(lines) AS text, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT review_id, filename, string_split(patch, chr(10)) AS lines FROM changed_files WHERE patch IS NOT NULL) AS p"""
_MARKED = """SELECT *, text LIKE '@@%' AS is_head, sum(CASE WHEN text LIKE '@@%' THEN 1 ELSE 0 END)
      OVER (PARTITION BY review_id, filename ORDER BY pos) AS h,
    CASE WHEN text LIKE '+%' THEN 'added' WHEN text LIKE '-%' THEN 'removed' WHEN text LIKE ' %' THEN 'context'
         WHEN text = '\\ No newline at end of file' THEN 'marker' ELSE 'bad' END AS kind FROM lines"""
_HEAD = "'^@@ -([0-9]+)(?:,([0-9]+))? \\+([0-9]+)(?:,([0-9]+))? @@.*$'"
_HEADS = f"""SELECT review_id, filename, h, pos, regexp_matches(text, {_HEAD}) AS fine,
      TRY_CAST(regexp_extract(text, {_HEAD}, 1) AS BIGINT) AS os,
      CASE WHEN regexp_matches(text, {_HEAD}) THEN coalesce(TRY_CAST(regexp_extract(text, {_HEAD}, 2) AS BIGINT), 1) END AS oc,
      TRY_CAST(regexp_extract(text, {_HEAD}, 3) AS BIGINT) AS ns,
      CASE WHEN regexp_matches(text, {_HEAD}) THEN coalesce(TRY_CAST(regexp_extract(text, {_HEAD}, 4) AS BIGINT), 1) END AS nc
    FROM marked WHERE is_head"""
_BODY = """SELECT m.*, d.os, d.oc, d.ns, d.nc,
      sum(CASE WHEN kind IN ('removed', 'context') THEN 1 ELSE 0 END) OVER w AS olds,
      sum(CASE WHEN kind IN ('added', 'context') THEN 1 ELSE 0 END) OVER w AS news
    FROM marked m LEFT JOIN heads d ON d.review_id = m.review_id AND d.filename = m.filename AND d.h = m.h
    WHERE NOT m.is_head WINDOW w AS (PARTITION BY m.review_id, m.filename, m.h ORDER BY m.pos)"""
_TOTALS = """SELECT d.*, coalesce(b.olds, 0) AS olds, coalesce(b.news, 0) AS news FROM heads d LEFT JOIN
    (SELECT review_id, filename, h, max(olds) AS olds, max(news) AS news FROM body GROUP BY ALL) b
    ON b.review_id = d.review_id AND b.filename = d.filename AND b.h = d.h"""
_ERRORS = """SELECT review_id, filename, arg_min(code, (pos, rank)) AS error FROM (
      SELECT review_id, filename, pos, 1 AS rank, CASE WHEN h = 0 OR kind = 'bad' THEN 'invalid_diff_body'
          WHEN olds > oc OR news > nc THEN 'invalid_diff_counts' END AS code FROM body
      UNION ALL
      SELECT review_id, filename, pos, 0, CASE WHEN p_olds < p_oc OR p_news < p_nc THEN 'incomplete_diff_hunk'
          WHEN NOT fine THEN 'invalid_diff_hunk' WHEN (oc > 0 AND os < 1) OR (nc > 0 AND ns < 1) THEN 'invalid_diff_position'
          WHEN os < p_os + p_oc OR ns < p_ns + p_nc THEN 'overlapping_diff_hunks' END
      FROM (SELECT *, lag(olds) OVER w AS p_olds, lag(news) OVER w AS p_news, lag(oc) OVER w AS p_oc, lag(nc) OVER w AS p_nc,
                   lag(os) OVER w AS p_os, lag(ns) OVER w AS p_ns FROM totals
            WINDOW w AS (PARTITION BY review_id, filename ORDER BY h))
      UNION ALL
      SELECT l.review_id, l.filename, max(l.pos) + 1, 2, CASE WHEN max(t.h) IS NULL OR arg_max(t.olds < t.oc OR t.news < t.nc, t.h)
          THEN 'incomplete_diff_hunk' END
      FROM lines l LEFT JOIN totals t ON t.review_id = l.review_id AND t.filename = l.filename GROUP BY ALL
    ) WHERE code IS NOT NULL GROUP BY ALL"""
_NUMBERED = """SELECT b.review_id, b.filename, CAST(b.h - 1 AS INTEGER) AS hunk, b.pos, b.kind,
      CASE WHEN b.kind <> 'added' THEN CAST(b.os + b.olds - 1 AS BIGINT) END AS old_line,
      CASE WHEN b.kind <> 'removed' THEN CAST(b.ns + b.news - 1 AS BIGINT) END AS new_line, b.text
    FROM body b LEFT JOIN errors e ON e.review_id = b.review_id AND e.filename = b.filename
    WHERE e.error IS NULL AND b.kind <> 'marker'"""
DIFF = dict(lines=_LINES, marked=_MARKED, heads=_HEADS, body=_BODY, totals=_TOTALS, errors=_ERRORS, numbered=_NUMBERED)


def scoped(spark: SparkSession, sf_dir: str, limits: Limits = LIMITS) -> DataFrame:
    return C.scope_reason(view(spark, sf_dir, "changed_files"), limits)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "changed_files")


# --- scope ---------------------------------------------------------------------------------

@query("scope_reason", "OP-C1", "OP-C2", headline=True, sql=oracle(
    "SELECT review_id, filename, reason, CAST(patch_chars AS BIGINT) AS patch_chars FROM scoped", scoped=_reason(LIMITS)))
def _scope_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(spark, sf_dir).select("review_id", "filename", "reason", F.col("patch_chars").cast("bigint").alias("patch_chars"))


@query("scope_budget", "OP-C3", headline=True, sql=oracle(
    "SELECT review_id, filename, reason, CAST(patch_chars AS BIGINT) AS patch_chars FROM decided", **_SCOPE))
def _scope_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_scope_budget(scoped(spark, sf_dir), LIMITS).withColumn("patch_chars", F.col("patch_chars").cast("bigint"))


@query("scope_summary", "OP-C4", sql=oracle(
    """SELECT review_id, bool_or(reason IS NOT NULL) AS limited, count(*) AS total_files,
         count(*) FILTER (WHERE reason IS NULL) AS selected_files,
         CAST(coalesce(sum(patch_chars) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS total_patch_chars,
         coalesce(string_agg(filename || '=' || reason || '/' || CAST(patch_chars AS VARCHAR), ';' ORDER BY filename)
                  FILTER (WHERE reason IS NOT NULL), '') AS skipped
       FROM decided GROUP BY review_id""", **_SCOPE))
def _scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = C.scope_document(C.apply_scope_budget(scoped(spark, sf_dir), LIMITS), LIMITS)
    skipped = F.transform("skipped_files", lambda f: F.concat(
        f["filename"], F.lit("="), f["reason"], F.lit("/"), f["patch_chars"].cast("string")))
    return document.select("review_id", "limited", "total_files", "selected_files", "total_patch_chars",
                           F.array_join(skipped, ";").alias("skipped"))


@query("scope_document", "OP-C4", sql=oracle(
    f"""SELECT review_id, 0 AS page, 1 AS pages, bool_or(reason IS NOT NULL) AS limited, count(*) AS total_files,
         count(*) FILTER (WHERE reason IS NULL) AS selected_files,
         CAST(coalesce(sum(patch_chars) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS total_patch_chars,
         coalesce('[' || string_agg('{{"filename":"' || filename || '","reason":"' || reason || '","patch_chars":' || CAST(patch_chars AS VARCHAR) || '}}', ',' ORDER BY filename)
                  FILTER (WHERE reason IS NOT NULL) || ']', '[]') AS skipped_files,
         {LIMITS.max_files} AS max_files, {LIMITS.max_patch_chars_per_file} AS max_patch_chars_per_file, {LIMITS.max_total_patch_chars} AS max_total_patch_chars
       FROM decided GROUP BY review_id""", **_SCOPE))
def _scope_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = C.scope_document(C.apply_scope_budget(scoped(spark, sf_dir), LIMITS), LIMITS)
    return document.select(
        "review_id", F.col("page").cast("int").alias("page"), F.col("pages").cast("int").alias("pages"), "limited", "total_files", "selected_files",
        "total_patch_chars", F.to_json("skipped_files").alias("skipped_files"), "max_files", "max_patch_chars_per_file", "max_total_patch_chars")


_HEADERS = """SELECT review_id, md5(CAST(review_id AS VARCHAR)) AS expected_head,
      CASE WHEN review_id % 7 = 1 THEN 'moved' ELSE md5(CAST(review_id AS VARCHAR)) END AS head_sha,
      'base' || CAST(review_id AS VARCHAR) AS base_sha, CAST(CASE WHEN review_id % 11 = 2 THEN 3001 ELSE n END AS BIGINT) AS changed_files,
      CASE WHEN review_id % 7 = 2 THEN 'moved' ELSE md5(CAST(review_id AS VARCHAR)) END AS later_head,
      CASE WHEN review_id % 9 = 3 THEN 'rebased' ELSE 'base' || CAST(review_id AS VARCHAR) END AS later_base,
      CAST(CASE WHEN review_id % 5 = 4 THEN n + 1 ELSE n END AS BIGINT) AS later_files, n
    FROM (SELECT review_id, count(*) AS n FROM changed_files GROUP BY review_id) AS r"""


@query("scope_snapshot_guard", "OP-C5", sql=oracle(
    """SELECT review_id, CASE WHEN head_sha <> expected_head THEN 'head_changed' WHEN changed_files > 3000 THEN 'github_file_limit_exceeded'
         WHEN later_head <> expected_head OR later_base <> base_sha THEN 'head_or_base_changed'
         WHEN n <> later_files THEN 'github_incomplete_files' END AS snapshot_error FROM headers""", headers=_HEADERS))
def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = files(spark, sf_dir).select("review_id", "filename")
    n = listed.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    review, head = F.col("review_id"), F.md5(F.col("review_id").cast("string"))
    base = F.concat(F.lit("base"), review.cast("string"))
    before = n.select(
        "review_id", head.alias("expected_head"), F.when(review % 7 == 1, "moved").otherwise(head).alias("head_sha"),
        base.alias("base_sha"), F.when(review % 11 == 2, 3001).otherwise(F.col("n")).alias("changed_files"))
    after = n.select(
        "review_id", F.when(review % 7 == 2, "moved").otherwise(head).alias("head_sha"),
        F.when(review % 9 == 3, "rebased").otherwise(base).alias("base_sha"),
        F.when(review % 5 == 4, F.col("n") + 1).otherwise(F.col("n")).alias("changed_files"))
    return C.check_snapshots(before, after, listed).select("review_id", "snapshot_error")


# --- diffs ------------------------------------------------------------------------------------

@query("diff_patch_lines", "OP-D1", headline=True, sql=oracle("SELECT review_id, filename, pos, text FROM lines", lines=_LINES))
def _patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.patch_lines(files(spark, sf_dir))


@query("diff_hunks", "OP-D2", sql=oracle(
    """SELECT review_id, filename, CAST(h - 1 AS INTEGER) AS hunk, pos, os AS old_start, oc AS old_count, ns AS new_start,
         nc AS new_count FROM heads""", lines=_LINES, marked=_MARKED, heads=_HEADS))
def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hunks(files(spark, sf_dir))


@query("diff_numbered_lines", "OP-D3", headline=True, sql=oracle("SELECT * FROM numbered", **DIFF))
def _diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_lines(files(spark, sf_dir))


@query("diff_errors", "OP-D4", headline=True, sql=oracle(
    """SELECT c.review_id, c.filename, e.error FROM changed_files c LEFT JOIN errors e ON e.review_id = c.review_id
       AND e.filename = c.filename WHERE c.patch IS NOT NULL""", **DIFF))
def _diff_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_errors(files(spark, sf_dir))


# Patches broken in every way the rules name, made from whole texts.
_BROKEN = """SELECT doc_id AS review_id, 'f' AS filename, CASE doc_id % 8
    WHEN 0 THEN '@@ -1 +1 @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+')
    WHEN 1 THEN text
    WHEN 2 THEN '@@ -0,1 +0,1 @@' || chr(10) || ' x' || chr(10) || text
    WHEN 3 THEN '@@ -5,1 +5,1 @@' || chr(10) || ' x' || chr(10) || '@@ -5,1 +6,1 @@' || chr(10) || ' ' || text
    WHEN 4 THEN '@@ -5,2 +5,1 @@' || chr(10) || ' x' || chr(10) || '@@ -9,1 +9,1 @@' || chr(10) || ' ' || text
    WHEN 5 THEN '@@ bad @@' || chr(10) || text
    WHEN 6 THEN '@@ -5,1 +5,0 @@ tail' || chr(10) || '-x' || chr(10) || '\\ No newline at end of file' || chr(10) || text
    ELSE '@@ -3 +3 @@' || chr(10) || '-old' || chr(10) || '+new' || chr(10) || '\\ No newline at end of file' END AS patch FROM $documents"""
_BROKEN_LINES = """SELECT review_id, filename, unnest(lines) AS text, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT review_id, filename, CASE WHEN lines[-1] = '' THEN list_slice(lines, 1, -2) ELSE lines END AS lines
          FROM (SELECT review_id, filename, string_split(patch, chr(10)) AS lines FROM broken))"""


@query("diff_errors_broken", "OP-D4", sql=oracle(
    """SELECT c.review_id, c.filename, e.error FROM broken c LEFT JOIN errors e ON e.review_id = c.review_id
       AND e.filename = c.filename""", broken=_BROKEN, **{**DIFF, "lines": _BROKEN_LINES}))
def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"parquet.`{sf_dir}/documents.parquet`"
    return D.diff_errors(spark.sql(_BROKEN.replace("$documents", table).replace("\\", "\\\\")))


@query("diff_changed_lines", "OP-D5", headline=True, sql=oracle(
    """SELECT DISTINCT review_id, filename, 'added' AS side, new_line AS line FROM numbered WHERE kind = 'added'
       UNION ALL SELECT DISTINCT review_id, filename, 'new', new_line FROM numbered WHERE new_line IS NOT NULL
       UNION ALL SELECT DISTINCT review_id, filename, 'removed', old_line FROM numbered WHERE kind = 'removed'""", **DIFF))
def _changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.changed_lines(files(spark, sf_dir))


_WHOLE = """SELECT doc_id, CASE WHEN lines[-1] = '' THEN list_slice(lines, 1, -2) ELSE lines END AS lines
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"""


@query("diff_full_file_patch", "OP-D6", sql=oracle(
    """SELECT doc_id, sha256(patch) AS digest, length(patch) AS chars FROM (SELECT doc_id, '@@ -0,0 +1,' || CAST(len(lines) AS VARCHAR)
         || ' @@' || chr(10) || array_to_string(list_transform(lines, lambda x: '+' || x), chr(10)) AS patch FROM whole)""", whole=_WHOLE))
def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    patched = D.full_file_patch(view(spark, sf_dir, "documents").select("doc_id", "text"))
    return patched.select("doc_id", F.sha2("patch", 256).alias("digest"), F.length("patch").cast("bigint").alias("chars"))


@query("diff_line_counts", "OP-D7", sql=oracle(
    "SELECT doc_id, CAST(len(lines) AS INTEGER) AS text_lines, CAST(len(lines) AS INTEGER) AS byte_lines FROM whole", whole=_WHOLE))
def _line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = view(spark, sf_dir, "documents").select("doc_id", "text")
    both = D.file_line_counts(D.file_line_counts(documents).withColumnRenamed("line_count", "text_lines"), mode="bytes")
    return both.select("doc_id", "text_lines", F.col("line_count").alias("byte_lines"))


# --- rules over changed lines --------------------------------------------------------------------

RULES = (
    E.Rule("long_run", "[aeiou]{4}", "medium"),
    E.Rule("digits", "[0-9]{3,}", "low"),
    E.Rule("secret_like", "(?i)(password|secret|api_key)", "high"),
    E.Rule("mail", "[a-z0-9.]+@[a-z0-9]+[.][a-z]+", "high", ".py"),
)
_HITS = "\nUNION ALL\n".join(
    f"""SELECT review_id, filename, new_line, '{r.id}' AS rule_id, '{r.severity}' AS severity FROM numbered
        WHERE kind = 'added' AND filename LIKE '%{r.suffix}' AND regexp_matches(text, '{r.pattern}')""" for r in RULES)


@query("finding_scan_rules", "OP-E17", sql=oracle(_HITS, **DIFF))
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = E.scan_rules(D.diff_lines(files(spark, sf_dir)), RULES)
    return hits.select("review_id", "filename", "new_line", "rule_id", "severity")


# --- batch guard and model input ---------------------------------------------------------------------

GUARD = Limits(max_files=12, max_source_bytes_per_file=3_000)


@query("finding_static_batch_guard", "OP-E4", sql=oracle(
    """SELECT review_id, CASE WHEN count(*) > 12 THEN 'analyzer_file_limit' ELSE arg_min(code, filename) FILTER (WHERE code IS NOT NULL) END AS status,
         count(*) AS files
       FROM (SELECT s.review_id, s.filename, CASE WHEN s.filename NOT LIKE '%.py' OR s.content_bytes > 3000 THEN 'analyzer_source_limit'
               ELSE e.error END AS code FROM scoped s LEFT JOIN errors e ON e.review_id = s.review_id AND e.filename = s.filename
             WHERE s.reason IS NULL) GROUP BY review_id""", scoped=_reason(Limits()), **DIFF))
def _guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.static_batch_guard(scoped(spark, sf_dir, Limits()).filter("reason IS NULL"), GUARD)


ADMIT = Limits(ai_max_files=4, ai_max_diff_chars=4_000, ai_max_total_input_chars=30_000, ai_max_retries=1)
_COSTED = """SELECT review_id, filename, length(patch) AS patch_chars, CAST(length(patch) + 500 AS BIGINT) AS cost,
    CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM changed_files WHERE patch IS NOT NULL"""
_TRIED = """SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY filename) AS k FROM costed
    WHERE filename LIKE '%.py' AND patch_chars <= 4000"""
_SPENT = """SELECT review_id, CAST(0 AS BIGINT) AS k, '' AS filename, 0 AS taken, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT DISTINCT review_id FROM tried)
    UNION ALL
    SELECT t.review_id, t.k, t.filename, s.taken + CASE WHEN s.taken < 4 AND s.used + t.cost * 2 <= 30000 THEN 1 ELSE 0 END,
      s.used + CASE WHEN s.taken < 4 AND s.used + t.cost * 2 <= 30000 THEN t.cost * t.attempts ELSE 0 END,
      CASE WHEN s.taken >= 4 THEN 'ai_file_limit' WHEN s.used + t.cost * 2 > 30000 THEN 'ai_total_input_limit' END
    FROM spent s JOIN tried t ON t.review_id = s.review_id AND t.k = s.k + 1"""


@query("finding_admit_model_inputs", "OP-E11", sql=oracle(
    """SELECT review_id, filename, CASE WHEN filename NOT LIKE '%.py' THEN 'ai_unsupported_file' ELSE 'ai_diff_limit' END AS reason
       FROM costed WHERE filename NOT LIKE '%.py' OR patch_chars > 4000
       UNION ALL SELECT review_id, filename, reason FROM spent WHERE k > 0""", costed=_COSTED, tried=_TRIED, spent=_SPENT))
def _admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = files(spark, sf_dir).filter("patch IS NOT NULL").select(
        "review_id", "filename", F.length("patch").alias("patch_chars"), (F.length("patch") + 500).cast("bigint").alias("cost"),
        F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("attempts"))
    return E.admit_model_inputs(inputs, ADMIT).select("review_id", "filename", "reason")


def _escaped(column: str) -> str:
    gone = lambda cls: f"(length({column}) - length(regexp_replace({column}, '{cls}', '', 'g')))"
    return (f"(length({column}) + {gone('[\"\\\\\\\\\\x08\\x0C\\n\\r\\t]')} + 5 * {gone('[\\x00-\\x07\\x0B\\x0E-\\x1F]')}"
            f" + 5 * {gone('[\\x{80}-\\x{FFFF}]')} + 11 * {gone('[\\x{10000}-\\x{10FFFF}]')})")


@query("finding_model_requests", "OP-E12", sql=oracle(
    f"""SELECT doc_id, CAST({sum(len(n) + 6 for n in ('repository_name', 'file_path', 'patch', 'context')) + 1} + 100
          + length('org/repo') + length(filename) + {_escaped('patch')} + {_escaped('text')} AS BIGINT) AS cost
        FROM (SELECT doc_id, text, 'doc' || CAST(doc_id AS VARCHAR) || '.py' AS filename, '@@ -0,0 +1 @@' || chr(10) || '+' || lang AS patch
              FROM documents)"""))
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = view(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"),
        F.concat(F.lit("@@ -0,0 +1 @@\n+"), "lang").alias("patch"), F.lit("org/repo").alias("repository_name"))
    return E.model_requests(inputs, overhead=100).select("doc_id", "cost")
