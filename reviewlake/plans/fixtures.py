"""Views that give the test tables the shape of review data, in SQL both engines run.

``$name`` stands for a table of the test data: a parquet path for Spark, a view name for
the oracle. Views may use earlier views by plain name. Nothing is sampled or cut.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

# 10 % redeliveries, ignored event types and actions, 2 % invalid targets. ``seq`` is arrival order.
VIEWS["deliveries"] = """
SELECT 'd' || CAST(event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS STRING) AS delivery_id,
       CASE event_type WHEN 'error' THEN 'ping' ELSE 'pull_request' END AS event_type,
       CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'signup' THEN 'reopened'
            WHEN 'purchase' THEN 'closed' END AS action,
       user_id % 10 + 1 AS repository_id, 'org/repo' || CAST(user_id % 10 AS STRING) AS repository_name,
       CASE WHEN event_id % 50 = 7 THEN 0 ELSE user_id + 1 END AS pull_request_number,
       md5(CAST(user_id AS STRING) || ':' || CAST(CAST(floor(event_id / 200) AS BIGINT) AS STRING))
           || substr(md5(CAST(user_id AS STRING)), 1, 8) AS head_sha,
       user_id + 100 AS installation_id, ts AS received_at, event_id AS seq, value, props
FROM $events"""

# The same as landed bodies: broken JSON, wrong types, short hashes, padded or missing headers.
VIEWS["landed"] = """
SELECT CASE WHEN seq % 61 = 3 THEN '  ' || delivery_id || ' ' WHEN seq % 97 = 5 THEN '' ELSE delivery_id END AS delivery_id,
       event_type, received_at, seq, value,
       CASE WHEN seq % 41 = 6 THEN '[1]' WHEN seq % 43 = 7 THEN 'not json' ELSE
         '{"action":' || CASE WHEN seq % 29 = 4 THEN '7' WHEN action IS NULL THEN 'null' ELSE '"' || action || '"' END
         || ',"repository":{"id":' || CASE WHEN seq % 53 = 8 THEN 'true' ELSE CAST(repository_id AS STRING) END
         || ',"full_name":"' || CASE WHEN seq % 59 = 9 THEN '' ELSE repository_name END
         || '"},"pull_request":{"number":' || CASE WHEN seq % 47 = 10 THEN '"7"' WHEN seq % 67 = 11 THEN '2.0'
                                                   ELSE CAST(pull_request_number AS STRING) END
         || ',"head":{"sha":"' || CASE WHEN seq % 71 = 12 THEN substr(head_sha, 1, 39) ELSE head_sha END
         || '"},"base":{"sha":' || CASE WHEN seq % 5 = 0 THEN 'null' WHEN seq % 37 = 1 THEN '"zz"' ELSE '"' || head_sha || '"' END
         || '}},"installation":{"id":' || CAST(installation_id AS STRING) || '}}' END AS body_text
FROM deliveries"""

# All five statuses, attempts 0-4, due, future and missing deadlines.
VIEWS["review_jobs"] = """
SELECT o_orderkey AS id, 'org/repo' || CAST(o_custkey % 50 AS STRING) AS repository_name, o_custkey + 1 AS pull_request_number,
       md5(CAST(o_orderkey AS STRING)) || substr(md5(CAST(o_custkey AS STRING)), 1, 8) AS head_sha,
       CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing'
            WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'superseded'
            ELSE 'completed' END AS status,
       CAST(o_orderkey % 5 AS INT) AS attempt_count, o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'O' THEN NULL
            ELSE o_orderdate + CAST(o_orderkey % 97 AS INT) * INTERVAL '1' SECOND END AS started_at,
       CASE WHEN o_orderstatus IN ('O', 'P') THEN NULL
            ELSE o_orderdate + (CAST(o_orderkey % 97 AS INT) + CAST(CAST(floor(o_totalprice) AS BIGINT) % 600 AS INT) - 9)
                 * INTERVAL '1' SECOND END AS completed_at,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey + 100 END AS installation_id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '30' DAY END AS next_attempt_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '2' DAY END AS lease_expires_at,
       CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'in_progress' WHEN 2 THEN 'pending'
            WHEN 3 THEN 'retry_pending' WHEN 4 THEN 'enqueue_failed' WHEN 5 THEN 'published' ELSE 'failed' END AS publication_status,
       CAST(o_custkey % 6 AS INT) AS publication_attempt_count,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '60' DAY END AS next_publication_at,
       CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 1 END AS has_report, md5('lease' || CAST(o_orderkey AS STRING)) AS lease_token
FROM $orders"""

# Three sources, bad severities and bad lines. ``idx`` is the 0-based position in its review.
VIEWS["raw_findings"] = """
SELECT l_orderkey AS review_id, 'pkg' || CAST(l_suppkey % 5 AS STRING) || '/m' || CAST(l_partkey % 3 AS STRING) || '.py' AS file_path,
       CASE WHEN l_tax = 0.0 THEN 0 ELSE l_linenumber END AS line_number,
       CASE l_returnflag WHEN 'A' THEN 'ai' WHEN 'N' THEN 'ruff' ELSE 'bandit' END AS source,
       CASE l_partkey % 6 WHEN 0 THEN 'B605' WHEN 1 THEN 'B110' WHEN 2 THEN 'F401' WHEN 3 THEN 'F841' WHEN 4 THEN 'E722'
            ELSE 'security' END AS category,
       CASE WHEN l_discount >= 0.10 THEN 'critical' WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium'
            ELSE 'low' END AS severity,
       'part ' || CAST(l_partkey AS STRING) AS title, 'supplier ' || CAST(l_suppkey AS STRING) AS description,
       CASE WHEN l_linestatus = 'O' THEN 'fix ' || CAST(l_partkey AS STRING) END AS suggestion,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                               l_extendedprice, l_shipdate) - 1 AS BIGINT) AS idx,
       l_partkey, l_suppkey, l_shipdate
FROM $lineitem"""

# 20 files per review; every exclusion family; one- and two-hunk patches, deletions, a wrong
# count, missing patches. ``new_line_count`` stands for the line count of the file content.
VIEWS["changed_files"] = """
SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS review_id,
       CAST(n AS INT) * CASE WHEN doc_id % 5 = 4 THEN 2 ELSE 1 END AS new_line_count, length(text) AS content_bytes,
       CASE WHEN doc_id % 12 = 1 THEN 'vendor/' WHEN doc_id % 12 = 2 THEN 'src/Generated/' ELSE 'src/' END || 'doc'
         || CAST(doc_id AS STRING) || CASE WHEN doc_id % 12 = 3 THEN '.md' WHEN doc_id % 12 = 4 THEN '_pb2.py'
                                           WHEN doc_id % 12 = 5 THEN '.lock' ELSE '.py' END AS filename,
       CASE WHEN doc_id % 17 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status,
       CASE WHEN doc_id % 19 = 0 THEN NULL
            WHEN doc_id % 5 = 0 THEN '@@ -0,0 +1,' || n || ' @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+')
            WHEN doc_id % 5 = 1 THEN '@@ -1,' || n || ' +1,' || n || ' @@' || chr(10) || ' ' || replace(text, chr(10), chr(10) || ' ')
            WHEN doc_id % 5 = 2 THEN '@@ -1,' || n || ' +1,' || n || ' @@' || chr(10) || '-' || replace(text, chr(10), chr(10) || '-')
                 || chr(10) || '+' || replace(text, chr(10), chr(10) || '+')
            WHEN doc_id % 5 = 3 THEN '@@ -0,0 +1,' || CAST(CAST(n AS INT) + 1 AS STRING) || ' @@' || chr(10) || '+'
                 || replace(text, chr(10), chr(10) || '+')
            ELSE '@@ -1,' || n || ' +1,' || n || ' @@' || chr(10) || ' ' || replace(text, chr(10), chr(10) || ' ') || chr(10)
                 || '@@ -' || CAST(CAST(n AS INT) + 1 AS STRING) || ',0 +' || CAST(CAST(n AS INT) + 1 AS STRING) || ',' || n
                 || ' @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') END AS patch
FROM (SELECT doc_id, text, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS STRING) AS n FROM $documents) AS d"""

# Findings on those files; all rejection reasons and acceptance fire. The number of reviews
# grows with the tables. ``idx`` is the position in the review, with gaps: 20 files, 15 lists a file, below 32 findings a list.
VIEWS["review_findings"] = """
SELECT c.review_id, CASE WHEN l.l_suppkey % 17 = 0 THEN 'missing.py' ELSE c.filename END AS file_path,
       CASE WHEN l.line_number > 6 THEN l.line_number + 5000 ELSE l.line_number END AS line_number, l.source,
       CASE l.l_partkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'correctness' ELSE 'quality' END AS category,
       l.severity, l.title, l.description, l.suggestion,
       CAST(((c.doc_id % 20) * 15 + l.review_id % 15) * 32 + l.idx AS BIGINT) AS idx
FROM raw_findings AS l JOIN changed_files AS c ON c.doc_id = CAST(floor(l.review_id / 15) AS BIGINT)"""

# Truncated finishes, text that is no JSON, wrong envelopes, boolean lines, unknown severities.
VIEWS["model_responses"] = """
SELECT review_id, idx, CASE WHEN review_id % 11 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason,
       CASE WHEN review_id % 13 = 0 THEN 'not json' WHEN review_id % 13 = 1 THEN '{"items":[]}'
            WHEN review_id % 13 = 2 THEN '{"findings":{}}' WHEN review_id % 13 = 3 THEN '{"findings":[]}'
       ELSE '{"findings":[{"file_path":"' || file_path || '","line_number":'
         || CASE WHEN idx % 7 = 6 THEN 'true' ELSE CAST(line_number AS STRING) END
         || ',"source":"ai","category":"' || category || '","severity":"' || severity || '","title":"' || title
         || '","description":' || CASE WHEN idx % 5 = 4 THEN '5' ELSE '"' || description || '"' END
         || CASE WHEN idx % 4 = 3 THEN ',"suggestion":null' ELSE ',"suggestion":"s"' END
         || CASE WHEN l_suppkey % 9 = 8 THEN ',"extra":1' ELSE '' END || '}]}' END AS raw,
       length(title) * 10 AS prompt_tokens, CASE WHEN review_id % 9 = 0 THEN NULL ELSE length(description) END AS candidate_tokens,
       CASE WHEN idx % 3 = 0 THEN NULL ELSE length(file_path) END AS thought_tokens,
       CASE WHEN review_id % 8 = 0 THEN NULL ELSE length(title) * 10 + length(description) END AS total_tokens
FROM raw_findings"""

# Answers of two findings about one file of ``changed_files`` each.
VIEWS["file_responses"] = """
SELECT review_id, idx, file_path, CASE WHEN idx % 31 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason,
       CASE WHEN idx % 29 = 0 THEN '{"findings":[' ELSE '{"findings":['
         || '{"file_path":"' || file_path || '","line_number":' || CAST(line_number AS STRING) || ',"source":"'
         || CASE WHEN source = 'ruff' THEN 'ruff' ELSE 'ai' END || '","category":"' || category || '","severity":"' || severity
         || '","title":"' || title || '","description":"' || description || '","suggestion":"s"},'
         || '{"file_path":"' || CASE WHEN idx % 23 = 0 THEN 'other.py' ELSE file_path END
         || '","line_number":1,"source":"ai","category":"x","severity":"low","title":"t","description":"d","suggestion":"s"}]}'
       END AS raw
FROM review_findings"""

# Repeated keys on purpose: scoring is a multiset match.
VIEWS["expected_labels"] = """
SELECT 'case' || CAST(l_orderkey % 200 AS STRING) AS case_id, 'f' || CAST(l_partkey % 3 AS STRING) || '.py' AS file,
       l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN 'correctness' ELSE 'quality' END AS category
FROM $lineitem WHERE l_linestatus = 'F'"""

# Three experiments with raw rule ids. ``seq`` is unique and gives the input order.
VIEWS["experiment_findings"] = """
SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'ungrounded' WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'A' ELSE 'B' END AS experiment,
       'case' || CAST(l_orderkey % 200 AS STRING) AS case_id, 'f' || CAST(l_partkey % 3 AS STRING) || '.py' AS file_path,
       l_linenumber AS line_number, CASE l_returnflag WHEN 'A' THEN 'ai' WHEN 'N' THEN 'ruff' ELSE 'bandit' END AS source,
       CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN CASE WHEN l_partkey % 2 = 0 THEN 'F401' ELSE 'E722' END
            ELSE CASE WHEN l_partkey % 2 = 0 THEN 'B110' ELSE 'B605' END END AS category,
       l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                                              l_extendedprice, l_shipdate) AS seq
FROM $lineitem"""

# One status per experiment and case, taken from the orders of that case.
VIEWS["case_status"] = """
SELECT experiment, case_id, CASE WHEN bad > 0 AND experiment = 'B' THEN 'failed' WHEN bad > 0 AND experiment = 'ungrounded' THEN 'not_run'
                                 ELSE 'completed' END AS status
FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN 'ungrounded' WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'A' ELSE 'B' END AS experiment,
             'case' || CAST(o_orderkey % 200 AS STRING) AS case_id,
             sum(CASE WHEN o_orderkey % 400 < 60 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS bad
      FROM $orders GROUP BY 1, 2) AS c"""

# Outcome events of jobs: each event of the log belongs to the job its user points to.
VIEWS["stage_log"] = """
SELECT user_id AS review_id, ts, event_id AS seq,
       CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'static_completed' WHEN 'signup' THEN 'ai_completed'
            WHEN 'purchase' THEN 'analysis_completed' ELSE 'analysis_failed' END AS stage,
       CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'superseded'
            WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
       CASE event_type WHEN 'error' THEN CASE WHEN value < 50 THEN 'ai_http_503' WHEN value < 100 THEN 'ai_http_5033'
            WHEN value < 150 THEN 'analyzer_timeout' ELSE 'secret text' END END AS error,
       ts + INTERVAL '30' SECOND AS deadline, value
FROM $events"""


def _by_file() -> str:
    """``review_findings`` in the form Spark runs: the same rows, moved once.

    Source rows go to their file first, so that neither numbering them nor meeting the file moves them again,
    and they go as they came: texts are made of them afterwards.
    """
    numbering = re.compile(r"row_number\(\) OVER \(PARTITION BY (l_orderkey ORDER BY [^)]*)\)")
    order = numbering.search(VIEWS["raw_findings"]).group(1)
    file = "CAST(floor({0} / 15) AS BIGINT)"
    placed = f"(SELECT /*+ REPARTITION(file) */ *, {file.format('l_orderkey')} AS file FROM $lineitem)"
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY file, {order}) AS nth FROM {placed})"
    rows = numbering.sub("nth", VIEWS["raw_findings"]).replace("FROM $lineitem", f", file FROM {numbered}")
    return VIEWS["review_findings"].replace("FROM raw_findings AS l", f"FROM ({rows}) AS l").replace(file.format("l.review_id"), "l.file")


# The oracle runs the views as they stand.
SPARK_VIEWS = VIEWS | {"review_findings": _by_file()}


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def _closure(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Views a statement uses, directly or not, in the order they are defined."""
    found: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += _needs(views[name])
    return [name for name in VIEWS if name in found]


def _with(sql: str, tables: dict[str, str], ctes: dict[str, str] | None = None, views: dict[str, str] = VIEWS) -> str:
    extra = ctes or {}
    used = {name: views[name] for name in _closure(" ".join([sql, *extra.values()]), views)}
    parts = [f"{name} AS ({text})" for name, text in {**used, **extra}.items()]
    text = (f"WITH {'RECURSIVE ' if any('UNION ALL' in t for t in extra.values()) else ''}"
            + ",\n".join(parts) + "\n" + sql) if parts else sql
    return Template(text).safe_substitute(tables)


# Views written as tables beforehand, by folder and name; only the benchmark does that.
_PREPARED: dict[tuple[str, str], str] = {}


def prepare(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write every view as a table, so that what is timed afterwards starts from tables of this domain."""
    for name in VIEWS:
        view(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        _PREPARED[sf_dir, name] = f"{folder}/{name}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a plain table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if (sf_dir, name) in _PREPARED:
        return spark.read.parquet(_PREPARED[sf_dir, name])
    paths = {table: f"parquet.`{sf_dir}/{table}.parquet`" for table in TABLES}
    return spark.sql(_with(f"SELECT * FROM {name}", paths, views=SPARK_VIEWS))


def oracle(sql: str, **ctes: str) -> str:
    """A statement for the oracle with the views it uses in front; ``ctes`` follow the views in order."""
    return _with(sql, {table: table for table in TABLES}, ctes)
