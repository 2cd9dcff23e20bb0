"""Readers with explicit schemas, and the shaping of what they read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.binding import pin
from ..schemas import CASE_LABELS, CHANGED_FILE_RAW, DELIVERY, MODEL_RESPONSE

# Encodings a source file may declare in its first two lines and that we read.
ENCODING_COOKIE = r"(?m)\A(?:[^\n\r]*(?:\r\n|\r|\n))?[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)"
UTF8_NAMES = ("utf-8", "utf8", "utf_8", "u8", "utf-8-sig")
BOM = "\ufeff"


def read_deliveries(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Landed raw deliveries: body bytes plus headers. ``files_per_batch`` bounds a stream's micro-batches."""
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(DELIVERY).format(fmt).load(path)


def read_changed_files(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Changed files with ``row_ok``; see :func:`check_changed_files`."""
    return check_changed_files(spark.read.schema(CHANGED_FILE_RAW).format(fmt).load(path))


def check_changed_files(raw: DataFrame) -> DataFrame:
    """Typed counts and ``row_ok``: a name, a status, and three counts that are not negative."""
    counts = ("additions", "deletions", "changes")
    typed = raw.withColumns({name: F.col(name).try_cast("int") for name in counts})
    ok = (F.length("filename") >= 1) & F.col("status").isNotNull()
    for name in counts:
        ok = ok & (F.col(name) >= 0)
    return typed.withColumn("row_ok", F.coalesce(ok, F.lit(False)))


def snapshot_status(files: DataFrame, review: str = "review_id") -> DataFrame:
    """Per review: one broken row fails the snapshot."""
    bad = F.count(F.when(~F.col("row_ok"), 1))
    return files.groupBy(review).agg((bad > 0).alias("failed"), F.count(F.lit(1)).alias("files"), bad.alias("bad_rows"))


def decode_sources(df: DataFrame, content: str = "content") -> DataFrame:
    """Base64 text -> ``bytes``, ``text``, ``encoding`` and ``skip_reason``.

    UTF-8 with or without a byte order mark is decoded natively; broken bytes and any other
    declared encoding give ``ai_source_encoding`` and no text, the row stays.
    """
    data = F.try_to_binary(F.regexp_replace(F.col(content), r"\s+", ""), F.lit("base64"))
    decoded = df.withColumn("bytes", data)
    plain = F.col("bytes").cast("string")
    valid = F.is_valid_utf8(plain)
    declared = F.lower(F.regexp_extract(F.when(valid, plain), ENCODING_COOKIE, 1))
    readable = valid & ((declared == "") | declared.isin(*UTF8_NAMES))
    has_mark = F.coalesce(plain.startswith(BOM), F.lit(False))
    return (decoded
            .withColumn("text", F.when(readable, F.when(has_mark, F.substring(plain, 2, 2**31 - 1)).otherwise(plain)))
            .withColumn("encoding", F.when(readable, F.when(has_mark, "utf-8-sig").otherwise("utf-8")))
            .withColumn("skip_reason", F.when(~F.coalesce(readable, F.lit(False)), "ai_source_encoding"))
            .drop(content))


def _text(item: Column, path: str) -> Column:
    return V.text(item, path)


def read_tool_output(df: DataFrame, tool: str, keys: Sequence[str] = ("review_id",), raw: str = "raw") -> DataFrame:
    """One row per reported issue, with ``pos`` and ``bad`` when a required field is missing or mistyped.

    Output that is no JSON of the expected shape yields one ``bad`` row without fields.
    """
    doc = pin(df, _doc=V.parse(F.col(raw)))
    listing = F.col("_doc") if tool == "ruff" else V.at(F.col("_doc"), "$.results")
    issues = V.elements(listing)
    shaped = issues.isNotNull() & (F.lit(True) if tool == "ruff" else V.elements(F.col("_doc"), "$.errors").isNotNull())
    members = F.when(shaped, issues)
    broken = F.array(F.lit(None).cast("variant"))
    rows = doc.select(*keys, shaped.alias("_shaped"),
                      F.posexplode(F.coalesce(members, broken)).alias("pos", "_item"))
    item = F.col("_item")
    if tool == "ruff":
        code = V.at(item, "$.code")
        fields = {
            "file_path": _text(item, "$.filename"), "line_number": V.whole(item, "$.location.row").try_cast("int"),
            "code": _text(item, "$.code"), "message": _text(item, "$.message"),
            "fix_message": _text(item, "$.fix.message")}
        bad = ~(V.is_absent(code) | V.is_text(code))
        required = ("file_path", "line_number", "message")
    elif tool == "bandit":
        fields = {
            "file_path": _text(item, "$.filename"), "line_number": V.whole(item, "$.line_number").try_cast("int"),
            "test_id": _text(item, "$.test_id"), "test_name": _text(item, "$.test_name"),
            "issue_text": _text(item, "$.issue_text"), "issue_severity": _text(item, "$.issue_severity")}
        bad, required = F.lit(False), tuple(fields)
    else:
        raise ValueError(f"unknown tool {tool}")
    typed = rows.select(*keys, "pos", "_shaped", (~F.col("_shaped") | bad).alias("_bad"),
                        *[value.alias(name) for name, value in fields.items()])
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    return typed.withColumn("bad", F.col("_bad") | missing).drop("_bad", "_shaped")


def read_tool_errors(df: DataFrame, keys: Sequence[str] = ("review_id",), raw: str = "raw") -> DataFrame:
    """File errors reported beside the issues: keys, ``file_path``, ``reason``."""
    errors = F.try_variant_get(V.parse(F.col(raw)), "$.errors", "array<variant>")
    rows = df.select(*keys, F.explode(errors).alias("_item"))
    return rows.select(*keys, _text(F.col("_item"), "$.filename").alias("file_path"),
                       _text(F.col("_item"), "$.reason").alias("reason"))


def read_model_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Envelope of a model call -> ``finish_reason``, ``raw`` and the token counters.

    The first candidate counts; its parts that are no thoughts are joined in order.
    """
    parsed = df.withColumn("_r", F.from_json(F.col(response), MODEL_RESPONSE))
    first = F.get(F.col("_r.candidates"), F.lit(0))
    parts = F.filter(first["content"]["parts"], lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    usage = F.col("_r.usageMetadata")
    return parsed.select(
        *[c for c in df.columns if c != response], first["finishReason"].alias("finish_reason"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("raw"),
        usage["promptTokenCount"].alias("prompt_tokens"), usage["candidatesTokenCount"].alias("candidate_tokens"),
        usage["thoughtsTokenCount"].alias("thought_tokens"), usage["totalTokenCount"].alias("total_tokens"))


def read_cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Labelled case folders -> files (``case_id, name, content``) and expected labels.

    ``root`` may hold any number of ``case_*`` folders; each file is one row.
    """
    files = (spark.read.format("binaryFile").load(f"{root}/case_*/*")
             .select(F.regexp_extract("path", r"(case_[^/]*)/([^/]+)\z", 1).alias("case_id"),
                     F.regexp_extract("path", r"(case_[^/]*)/([^/]+)\z", 2).alias("name"), "content"))
    labels = (files.filter(F.col("name") == "labels.json")
              .select(F.from_json(F.col("content").cast("string"), CASE_LABELS).alias("l")).select("l.*"))
    expected = labels.select("case_id", F.explode("expected").alias("e")).select(
        "case_id", "e.file", "e.line", "e.category")
    return files, expected
