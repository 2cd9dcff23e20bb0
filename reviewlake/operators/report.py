"""Merged findings and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDING_COLUMNS, SEVERITIES
from .skew import number_whole, number_within

MERGE_KEY = ("file_path", "line_number", "category")
INDEX_CHUNK = 1024
REPORT_PAGE = 1000
# Lines per block when findings of a review are numbered in (path, line, category) order.
LINE_BLOCK = 256
# Findings up to which one task numbers and pages a whole review; the rows of a longer one are spread in blocks.
WHOLE_REVIEW = 100_000


def severity_rank(column: Column | str = "severity") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    rank = F.lit(len(SEVERITIES))
    for position, level in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(column == level, position).otherwise(rank)
    return rank


def merge_findings(accepted: DataFrame, review: str = "review_id", **more: Column) -> DataFrame:
    """One row per exact (path, line, category): the representative, ``sources``, ``merged`` and ``more`` aggregates.

    Everything is a partial aggregate; ``sources`` holds at most the three known names.
    The representative is the least row in the order of its own fields, so its texts travel once.
    The original indices are rows of :func:`provenance`.
    """
    least = F.struct(severity_rank().alias("rank"), "source", "title", "description", F.coalesce("suggestion", F.lit("")).alias("text"),
                     "idx", "severity", F.col("suggestion").isNull().alias("none"))
    merged = accepted.groupBy(review, *MERGE_KEY).agg(
        F.min(least).alias("_best"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("idx").alias("first_index"), F.count(F.lit(1)).alias("merged"), *[value.alias(name) for name, value in more.items()])
    best = {name: F.col(f"_best.{name}") for name in ("source", "severity", "title", "description")}
    best["suggestion"] = F.when(~F.col("_best.none"), F.col("_best.text"))
    return merged.select(review, *[best.get(n, F.col(n)).alias(n) for n in FINDING_COLUMNS], "sources", "first_index", "merged", *more)


def provenance(accepted: DataFrame, review: str = "review_id") -> DataFrame:
    """Ascending original indices of each merged finding, in chunks of the index range.

    An index is unique in its review, so a chunk holds at most :data:`INDEX_CHUNK` of them;
    a review with fewer findings has everything in chunk 0.
    """
    chunk = F.floor(F.col("idx") / INDEX_CHUNK).alias("chunk")
    return accepted.groupBy(review, *MERGE_KEY, chunk).agg(
        F.array_sort(F.collect_list("idx")).alias("original_indices"),
        F.array_sort(F.collect_set("source")).alias("sources"))


def severity_summary(merged: DataFrame, review: str = "review_id") -> DataFrame:
    """Total and count per severity, zero-filled, in one pass."""
    return merged.groupBy(review).agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count(F.when(F.col("severity") == level, 1)).alias(level) for level in SEVERITIES])


def accepted_summary(accepted: DataFrame, review: str = "review_id") -> DataFrame:
    """What :func:`severity_summary` gives for the merged rows, from the rows themselves.

    A representative has the least severity rank of its key, so the texts need not travel.
    """
    ranks = accepted.groupBy(review, *MERGE_KEY).agg(F.min(severity_rank()).alias("rank"))
    return ranks.groupBy(review).agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count(F.when(F.col("rank") == rank, 1)).alias(level) for rank, level in enumerate(SEVERITIES)])


def rejections(validated: DataFrame, review: str = "review_id") -> DataFrame:
    """Refused findings per review, as lists in chunks of the index range."""
    bad = validated.filter(F.col("reason").isNotNull())
    chunk = F.floor(F.col("idx") / INDEX_CHUNK).alias("chunk")
    entry = F.struct(F.col("idx").alias("index"), "reason")
    return bad.groupBy(review, chunk).agg(F.array_sort(F.collect_list(entry)).alias("rejected_findings"))


def report_order(review: str = "review_id") -> tuple[Column, list[Column]]:
    """Coarse and full order of findings inside a review."""
    coarse = F.struct(F.col("file_path"), F.floor(F.col("line_number") / LINE_BLOCK).alias("block"))
    return coarse, [F.col("file_path"), F.col("line_number"), F.col("category")]


def merged_entries(accepted: DataFrame, review: str = "review_id", size: int = REPORT_PAGE, whole: bool = False) -> DataFrame:
    """Merged findings with their ``original_indices``, ascending; ``part`` 0 is the whole of an ordinary one.

    A finding that more than ``size`` rows were merged into goes on in further parts, so its indices are
    numbered and collected in blocks, never in one list; only where a ``whole`` review is small enough for a task
    they are listed first and cut then.
    """
    keys = [review, *MERGE_KEY]
    if whole:
        merged = merge_findings(accepted, review, _indices=F.array_sort(F.collect_list("idx")))
        # A row without an index counts, and is not listed: the same places as in blocks.
        places = F.concat(F.array_repeat(F.lit(None).cast("bigint"), (F.col("merged") - F.size("_indices")).cast("int")), F.col("_indices"))
        begins = F.sequence(F.lit(1), F.col("merged").cast("int"), F.lit(size))
        cut = F.posexplode(F.transform(begins, lambda at: F.array_compact(F.slice(places, at, F.lit(size))))).alias("part", "original_indices")
        parts = merged.select(*[c for c in merged.columns if c != "_indices"], cut)
        return parts.filter(F.size("original_indices") > 0).withColumn("part", F.col("part").cast("bigint"))
    numbered = number_within(accepted.select(*keys, "idx"), keys, F.floor(F.col("idx") / INDEX_CHUNK), [F.col("idx")], "_nth")
    parts = (numbered.groupBy(*keys, F.floor((F.col("_nth") - 1) / size).alias("part"))
             .agg(F.array_sort(F.collect_list("idx")).alias("original_indices")))
    return parts.join(merge_findings(accepted, review), keys)


def build_reports(jobs: DataFrame, checked: DataFrame, statuses: DataFrame | None = None, measured: DataFrame | None = None,
                  review: str = "review_id", page_size: int = REPORT_PAGE, whole: int = WHOLE_REVIEW) -> DataFrame:
    """Nested reports in pages; each job has one, also without findings.

    ``jobs``: review and ``status``; ``checked``: findings with ``reason``, as :func:`validate_findings` gives
    them, best as a table, since they are read several times; ``statuses``: ``static_analysis`` and ``ai_analysis``;
    ``measured``: see :func:`measurements`.

    A page holds up to ``page_size`` merged findings with their original indices, original findings as they
    came, and refused ones with index and reason, each list in its own order. Page 0 is the whole report of
    an ordinary review. The three lists meet in one group per (review, page). Totals, statuses, errors and
    measurements are on every page.

    The rows of reviews with up to ``whole`` findings move once, to the task of their review, where they are numbered
    and paged. Longer reviews, of which there are few, are named to all tasks and their lists are numbered in blocks,
    so neither a row nor a task ever holds such a review.
    """
    rows_of = checked.filter(F.col(review).isNotNull()).groupBy(review).agg(F.count(F.lit(1)).alias("rows"))
    long = [row[0] for row in rows_of.filter(F.col("rows") > whole).select(review).collect()]
    listed = F.col(review).isin(long)
    parts = [(jobs.filter(~listed), checked.filter(~listed), True), (jobs.filter(listed), checked.filter(listed), False)] if long else [(jobs, checked, True)]
    return reduce(DataFrame.unionByName, [_reports(*part, statuses, measured, review, page_size) for part in parts])


def _reports(jobs: DataFrame, checked: DataFrame, whole: bool, statuses: DataFrame | None, measured: DataFrame | None,
             review: str, page_size: int) -> DataFrame:
    if whole:
        checked = checked.repartition(review)
    number = number_whole if whole else number_within
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    coarse, order = report_order(review)
    entries = number(merged_entries(accepted, review, page_size, whole), [review], coarse, [*order, F.col("part")], "rn")
    block = F.floor(F.col("idx") / INDEX_CHUNK)
    originals = number(checked.select(review, "idx", *FINDING_COLUMNS), [review], block, [F.col("idx")], "rn")
    refused = number(checked.filter(F.col("reason").isNotNull()).select(review, "idx", "reason"), [review], block, [F.col("idx")], "rn")
    kinds = {"findings": (entries, F.struct("rn", *FINDING_COLUMNS, "original_indices", "part", "sources")),
             "original_findings": (originals, F.struct(F.col("idx").alias("index"), *FINDING_COLUMNS)),
             "rejected_findings": (refused, F.struct(F.col("idx").alias("index"), "reason"))}
    base = jobs.select(review, "status").join(accepted_summary(accepted, review), review, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    fields = [F.col("status"), F.struct(*[zero(n) for n in ("total_findings", *SEVERITIES)]).alias("summary")]
    if statuses is not None:
        base = base.join(statuses.select(review, "static_analysis", "ai_analysis"), review, "left")
        fields += [F.struct("static_analysis", "ai_analysis").alias("analysis"), component_errors().alias("component_errors")]
    if measured is not None:
        columns = [c for c in measured.columns if c != review]
        base = base.join(measured.select(review, F.struct(*columns).alias("measurements")), review, "left")
        fields.append(F.col("measurements"))
    # What a review has on every page comes as a row of each of its pages, so the lists are not joined with it:
    # every page but the first one has entries.
    held = checked.groupBy(review).agg(F.count(F.lit(1)).alias("_held"))
    last = F.greatest(F.floor((F.coalesce("_held", F.lit(0)) - 1) / page_size), F.lit(0))
    rows = base.filter(F.col(review).isNotNull()).join(held, review, "left").select(
        review, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("page"), F.struct(*fields).alias("_base"))
    for name, (listed, entry) in kinds.items():
        listed = listed.select(review, F.floor((F.col("rn") - 1) / page_size).alias("page"), entry.alias(name))
        rows = rows.unionByName(listed, allowMissingColumns=True)
    pages = rows.groupBy(review, "page").agg(F.collect_list("_base").alias("_base"), *[F.array_sort(F.collect_list(name)).alias(name) for name in kinds])
    pages = pages.filter((F.col("page") == 0) | (F.greatest(*[F.size(name) for name in kinds]) > 0))
    return pages.select("*", F.explode("_base").alias("_of")).select(review, "_of.*", "page", *kinds)


def component_errors() -> Column:
    """Codes of the components that failed, by component; an empty map if none did."""
    codes = F.array(*[F.when(F.col(name) == "failed", F.struct(F.lit(name), F.lit(f"{name}_failed"))) for name in ("static_analysis", "ai_analysis")])
    return F.map_from_entries(F.array_compact(codes))


def measurements(jobs: DataFrame, findings: DataFrame, stages: DataFrame | None = None, review: str = "review_id") -> DataFrame:
    """Queue wait, creation-to-report and per-stage seconds, and finding counts by source family.

    ``jobs``: review, ``created_at``, ``started_at``, ``reported_at``; ``stages``: review and seconds of each
    stage, as :func:`lifecycle.component_seconds` gives them. What was not run or not recorded is null.
    """
    counts = findings.groupBy(review).agg(
        F.count(F.when(F.col("source") != "ai", 1)).alias("static_findings"),
        F.count(F.when(F.col("source") == "ai", 1)).alias("ai_findings"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    joined = jobs.join(counts, review, "left")
    timed = [] if stages is None else [c for c in stages.columns if c != review]
    if timed:
        joined = joined.join(stages, review, "left")
    return joined.select(
        review, seconds_between("created_at", "started_at").alias("queue_wait_seconds"), *timed,
        seconds_between("created_at", "reported_at").alias("job_to_report_seconds"),
        zero("static_findings"), zero("ai_findings"))


def seconds_between(start: str, end: str) -> Column:
    """Difference in seconds with fractions; null when an end is missing."""
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)
