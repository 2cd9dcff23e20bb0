"""Explicit schemas; no reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T

DELIVERY = T.StructType([
    T.StructField("delivery_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

# Counts arrive as text so that a bad one marks its snapshot instead of failing the read.
CHANGED_FILE_RAW = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("additions", T.StringType()),
    T.StructField("deletions", T.StringType()),
    T.StructField("changes", T.StringType()),
    T.StructField("patch", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("suggestion", T.StringType()),
])

FINDING_COLUMNS = FINDING.fieldNames()

REVIEW_FINDING = T.StructType(
    [T.StructField("review_id", T.LongType()), T.StructField("idx", T.LongType()), *FINDING.fields]
)

MODEL_RESPONSE = T.StructType([
    T.StructField("candidates", T.ArrayType(T.StructType([
        T.StructField("finishReason", T.StringType()),
        T.StructField("content", T.StructType([
            T.StructField("parts", T.ArrayType(T.StructType([
                T.StructField("text", T.StringType()),
                T.StructField("thought", T.BooleanType()),
            ]))),
        ])),
    ]))),
    T.StructField("usageMetadata", T.StructType([
        T.StructField("promptTokenCount", T.LongType()),
        T.StructField("candidatesTokenCount", T.LongType()),
        T.StructField("thoughtsTokenCount", T.LongType()),
        T.StructField("totalTokenCount", T.LongType()),
    ])),
])

CASE_LABELS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("contract", T.StringType()),
    T.StructField("expected", T.ArrayType(T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]))),
])

# Enumerations of the data model.
SOURCES = ("ruff", "bandit", "ai")
SEVERITIES = ("high", "medium", "low")  # most severe first
JOB_STATUSES = ("queued", "processing", "completed", "failed", "superseded")
TOKEN_COUNTERS = ("prompt_tokens", "candidate_tokens", "thought_tokens", "total_tokens")
TERMINAL_STATUSES = ("completed", "failed", "superseded")

# Length caps of a strict finding.
TEXT_CAPS = {"file_path": 1024, "category": 128, "title": 256, "description": 4000, "suggestion": 4000}
