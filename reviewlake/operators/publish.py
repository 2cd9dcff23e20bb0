"""What is published for a review, and what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signing import stable_id
from ..limits import DEFAULT_LIMITS, Limits
from ..schemas import SEVERITIES
from .findings import row_ok
from .report import LINE_BLOCK
from .skew import lookup_join, number_within

# Wording of a published check.
SUGGESTION = "\nSuggestion: "
ADVICE = ("Findings are advisory. Incomplete analysis requires attention; "
          "severity alone does not fail this check.")
ANNOTATION = ("path", "start_line", "end_line", "annotation_level", "title", "message")
PUBLISHABLE = ("completed", "failed")


def annotations(merged: DataFrame, review: str = "review_id", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One annotation per merged finding, with its content ``fingerprint``.

    ``message`` is what may be published; ``full_message`` has the whole text, ``message_cut`` says if they differ.
    """
    has_suggestion = F.coalesce(F.col("suggestion"), F.lit("")) != ""
    message = F.concat("description", F.when(has_suggestion, F.concat(F.lit(SUGGESTION), "suggestion")).otherwise(""))
    rows = merged.select(
        review, F.col("file_path").alias("path"), F.col("line_number").alias("start_line"),
        F.col("line_number").alias("end_line"),
        F.when(F.col("severity") == "low", "notice").otherwise("warning").alias("annotation_level"),
        "title", F.substring(message, 1, limits.annotation_message_chars).alias("message"),
        message.alias("full_message"), (F.length(message) > limits.annotation_message_chars).alias("message_cut"),
        "category", row_ok().alias("schema_ok"))
    return rows.withColumn("fingerprint", stable_id(*[F.col(name) for name in ANNOTATION]))


def blocked_reviews(rows: DataFrame, changed: DataFrame, review: str = "review_id") -> DataFrame:
    """Reviews with an annotation off the added lines or against the row schema."""
    lines = changed.select(review, F.col("filename").alias("path"), F.col("line").alias("start_line"))
    # The lookup answers per location, so only distinct locations travel.
    places = rows.groupBy(review, "path", "start_line").agg(F.bool_and("schema_ok").alias("schema_ok"))
    off = places.join(lines, [review, "path", "start_line"], "left_anti").select(review)
    return off.unionByName(places.filter(~F.col("schema_ok")).select(review)).distinct()


def block_invalid(rows: DataFrame, changed: DataFrame, review: str = "review_id") -> DataFrame:
    """Annotations of reviews in which every one is in place; one bad row blocks its review."""
    return lookup_join(rows, blocked_reviews(rows, changed, review), [review], how="left_anti")


def pending_annotations(rows: DataFrame, published: DataFrame, review: str = "review_id") -> DataFrame:
    """Annotations whose fingerprint is not published yet; repeats inside one report stay."""
    return rows.join(published.select(review, "fingerprint"), [review, "fingerprint"], "left_anti")


def batch(rows: DataFrame, size: int | None = None, review: str = "review_id",
          limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``batch`` and ``position``: batches of ``size`` in (path, line, category) order."""
    size = size or limits.annotation_batch
    coarse = F.struct(F.col("path"), F.floor(F.col("start_line") / LINE_BLOCK).alias("block"))
    order = [F.col("path"), F.col("start_line"), F.col("category"), F.col("fingerprint")]
    numbered = number_within(rows, [review], coarse, order, "_rn")
    return (numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / size))
            .withColumn("position", (F.col("_rn") - 1) % size).drop("_rn"))


def _incomplete() -> Column:
    return (F.col("status") == "failed") | (F.col("static_analysis") == "failed") | (F.col("ai_analysis") == "failed")


def conclusion(reports: DataFrame) -> DataFrame:
    """Add ``conclusion``. ``reports``: ``status``, ``static_analysis``, ``ai_analysis``,
    ``total_findings``, ``scope_limited``."""
    held = ("limited", "disabled")
    limited = F.col("scope_limited") | F.col("static_analysis").isin(*held) | F.col("ai_analysis").isin(*held)
    return reports.withColumn("conclusion", F.when(_incomplete(), "action_required").when(
        (F.col("total_findings") > 0) | limited, "neutral").otherwise("success"))


def summary_text(reports: DataFrame) -> DataFrame:
    """Add ``summary``, the text of the check. Also needs ``files`` and the severity counts."""
    number = lambda name: F.col(name).cast("string")
    analysed = F.when(F.col("static_analysis") == "completed", F.col("files")).otherwise(0).cast("string")
    parts: list[Column] = [
        F.lit("Status: "), F.when(_incomplete(), "Incomplete").otherwise("Completed"),
        F.lit("\n\nFiles analyzed (static): "), analysed,
        F.lit("\nTotal findings: "), number("total_findings")]
    for level in SEVERITIES:
        parts += [F.lit(f"\n{level.capitalize()} severity: "), number(level)]
    parts += [F.lit("\n\nStatic analysis: "), F.col("static_analysis"), F.lit("\nAI analysis: "), F.col("ai_analysis"),
              F.lit("\nScope limited: "), F.initcap(F.col("scope_limited").cast("string")), F.lit("\n\n" + ADVICE)]
    return reports.withColumn("summary", F.concat(*parts))


def current_heads(deliveries: DataFrame) -> DataFrame:
    """Newest head per pull request; one row per pull request is all the state there is."""
    return deliveries.groupBy("repository_name", "pull_request_number").agg(
        F.max_by("head_sha", F.struct("received_at", "seq")).alias("current_head"))


def superseded(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Jobs whose head is no longer the newest of their pull request."""
    joined = lookup_join(jobs, heads, ["repository_name", "pull_request_number"], how="inner")
    return joined.filter(F.col("head_sha") != F.col("current_head"))


def match_checks(jobs: DataFrame, runs: DataFrame, name: str, review: str = "review_id") -> DataFrame:
    """Jobs with ``check_id``: the smallest id among remote runs of that job, name and head."""
    mine = (runs.filter(F.col("name") == name).groupBy(F.col("external_id").alias(review), "head_sha")
            .agg(F.min("id").alias("check_id")))
    return jobs.join(mine, [review, "head_sha"], "left")


def publication_decision(jobs: DataFrame, now: Column, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``decision`` and ``empty_report`` as of ``now``.

    ``jobs``: ``publication_status``, ``next_publication_at``, ``publication_attempt_count``,
    ``status``, ``has_report``; an id without a job has a null ``status``.
    """
    reported = F.col("has_report") == 1
    decision = (
        F.when(F.col("status").isNull(), "missing")
        .when(F.col("publication_status") == "published", "published")
        .when(F.col("next_publication_at") > now, "deferred")
        .when(F.col("publication_attempt_count") >= limits.max_attempts, "failed")
        .when(F.col("status") == "superseded", "superseded")
        .when(~F.col("status").isin(*PUBLISHABLE) | (~reported & (F.col("status") != "failed")), "not_ready")
        .otherwise("due"))
    return jobs.withColumn("decision", decision).withColumn(
        "empty_report", (F.col("decision") == "due") & ~reported)
