"""Which changed files of a review are looked at, and why the others are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import file_name, parent_parts, suffix
from ..limits import DEFAULT_LIMITS, Limits
from ..sources.folders import stored

# Path and content rules of the exclusion reasons.
IGNORED_DIRECTORIES = (
    "vendor", "vendored", "third_party", "third-party", "node_modules", ".venv", "venv",
    "__pycache__", "generated", "_generated", "build", "dist",
)
LOCK_SUFFIXES, LOCK_NAMES = (".lock", ".lock.py"), ("poetry.lock", "pipfile.lock")
GENERATED_SUFFIXES = ("_pb2.py", "_pb2_grpc.py", ".generated.py")
GENERATED_MARKERS = ("@generated", "automatically generated", "auto-generated", "autogenerated", "do not edit")
BINARY_PREFIXES = ("Binary files ", "GIT binary patch")
REVIEWED_SUFFIX = ".py"

TOO_MANY = "github_file_limit_exceeded"


def _any(column: Column, test: str, values: Sequence[str]) -> Column:
    result = F.lit(False)
    for value in values:
        result = result | getattr(column, test)(value)
    return result


def scope_reason(df: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``reason`` (first matching exclusion, or null) and ``patch_chars``."""
    path, patch = F.lower("filename"), F.coalesce(F.col("patch"), F.lit(""))
    name = F.col("_name")
    named = df.withColumn("_name", file_name(path)).withColumn("_parents", parent_parts(path))
    ignored = F.arrays_overlap(F.col("_parents"), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))
    generated = _any(name, "endswith", GENERATED_SUFFIXES) | let(
        F.lower(patch), lambda low: _any(low, "contains", GENERATED_MARKERS))
    reason = (
        F.when(ignored, "ignored_directory")
        .when(_any(name, "endswith", LOCK_SUFFIXES) | name.isin(*LOCK_NAMES), "lock_file")
        .when(suffix(name) != REVIEWED_SUFFIX, "unsupported_extension")
        .when(generated, "generated_file")
        .when(F.col("status") == "removed", "removed_file")
        .when(patch == "", "missing_patch")
        .when(patch.contains("\0") | _any(patch, "startswith", BINARY_PREFIXES), "binary_patch")
        .when(F.length(patch) > limits.max_patch_chars_per_file, "max_patch_chars_per_file")
    )
    return named.withColumn("reason", reason).withColumn("patch_chars", F.length(patch)).drop("_name", "_parents")


def walk_budget(items: DataFrame, review: str, name: str, size: str, used: Column, factor: int,
                max_items: int, max_total: int, reasons: tuple[str, str]) -> DataFrame:
    """Walk each review's items by name, take what fits, and add ``reason`` to the others.

    An item fits while fewer than ``max_items`` are taken and ``size * factor`` is within what is left
    of ``max_total``; it then uses up ``used``. A smaller item may fit after one that did not, so this is
    no running sum.

    First phase, candidates: when an item is taken, every earlier one that is no larger met a smaller
    total and was taken too. So an item with ``max_items`` earlier items that are no larger is out,
    whatever else the review holds. The least ``max_items`` names of each size pass, and of these the
    ones that come before the ``max_items``-th name among all smaller sizes, which are told apart by
    their number of bits. Second phase: one fold over a review's candidates decides. One join hands the
    at most ``max_items`` taken items to all items, which get their reasons from them. ``items`` is read
    three times, so callers hand over a narrow table.
    """
    order = ("_name", "_size", "_used")
    rows = items.withColumns({"_name": F.col(name), "_size": F.col(size).cast("bigint"), "_used": used.cast("bigint")})
    distinct = rows.groupBy(review, *order).agg(F.count(F.lit(1)).alias("_copies"))
    first = F.row_number().over(Window.partitionBy(review, "_size").orderBy(*order))
    able = (distinct.filter(F.col("_size") * factor <= max_total).withColumn("_nth", first)
            .filter(F.col("_nth") <= max_items))
    lists = (_thinned(able, review, max_items).groupBy(review)
             .agg(F.array_sort(F.collect_list(F.struct(*order, "_copies"))).alias("_items")))
    none = F.array().cast("array<struct<_name: string, _size: bigint, _used: bigint, taken: bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("count"), F.lit(0).cast("bigint").alias("total"), none.alias("taken"))

    def step(state: Column, item: Column) -> Column:
        left = max_total - state["total"] - item["_size"] * factor
        more = F.when(item["_used"] > 0, F.floor(left / item["_used"])).otherwise(item["_copies"])
        fits = F.when(left >= 0, F.least(item["_copies"], max_items - state["count"], 1 + more)).otherwise(0).cast("bigint")
        entry = F.struct(*[item[c].alias(c) for c in order], fits.alias("taken"))
        return F.struct(
            (state["count"] + fits).alias("count"), (state["total"] + fits * item["_used"]).alias("total"),
            F.when(fits > 0, F.array_append(state["taken"], entry)).otherwise(state["taken"]).alias("taken"))

    folded = lists.select(review, F.aggregate("_items", start, step)["taken"].alias("_taken"))
    joined = distinct.join(folded, review, "left").withColumn("_taken", F.coalesce("_taken", none))
    me = F.struct(*order)
    own = F.filter("_taken", lambda t: F.struct(*[t[c].alias(c) for c in order]) == me)
    before = F.aggregate(F.filter("_taken", lambda t: F.struct(*[t[c].alias(c) for c in order]) <= me),
                         F.lit(0).cast("bigint"), lambda n, t: n + t["taken"])
    decided = joined.select(
        review, *order, "_copies", F.coalesce(F.get(own, F.lit(0))["taken"], F.lit(0)).alias("_kept"),
        F.when(before >= max_items, reasons[0]).otherwise(reasons[1]).alias("_refusal"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")
    return decided.select(review, *order, "_kept", "_refusal", copies).select(
        review, F.col("_name").alias(name), F.col("_size").alias(size), F.col("_used").alias("_used"),
        F.when(F.col("_copy") > F.col("_kept"), F.col("_refusal")).alias("reason"))


def _thinned(able: DataFrame, review: str, max_items: int) -> DataFrame:
    """Items without ``max_items`` earlier ones in the classes of smaller sizes (sizes of fewer bits).

    A review has at most 64 classes with ``max_items`` names each, so what is handed back is bounded.
    """
    bits = F.length(F.bin(F.greatest("_size", F.lit(0))))
    classed = able.withColumn("_bits", bits)
    least = F.row_number().over(Window.partitionBy(review, "_bits").orderBy("_name", "_size", "_used"))
    ladder = (classed.withColumn("_rank", least).filter(F.col("_rank") <= max_items).groupBy(review)
              .agg(F.array_sort(F.collect_list(F.struct("_name", "_bits"))).alias("_ladder")))

    def limit(ladder: Column, n: Column) -> Column:
        smaller = F.filter(ladder, lambda e: e["_bits"] < n)
        return F.struct(n.alias("bits"), F.get(smaller, F.lit(max_items - 1))["_name"].alias("last"))

    classes = F.array_distinct(F.transform("_ladder", lambda e: e["_bits"]))
    limits = ladder.select(review, F.map_from_entries(F.transform(classes, lambda n: limit(F.col("_ladder"), n))).alias("_limits"))
    joined = classed.join(limits, review)
    return joined.filter(F.coalesce(F.col("_name") <= F.col("_limits")[F.col("_bits")], F.lit(True))).drop("_bits", "_limits")


def apply_scope_budget(df: DataFrame, limits: Limits = DEFAULT_LIMITS, review: str = "review_id") -> DataFrame:
    """Final ``reason`` per file of :func:`scope_reason` output, without the patch text.

    Files with a reason keep it and take no part in the budgets; see :func:`walk_budget` for the others.
    """
    # The rules run over whole patches, so their results are kept: names, reasons and sizes.
    files = stored(df.select(review, "filename", "reason", "patch_chars"), "scope")
    walked = walk_budget(files.filter(F.col("reason").isNull()), review, "filename", "patch_chars", F.col("patch_chars"), 1,
                         limits.max_files, limits.max_total_patch_chars, ("max_files", "max_total_patch_chars"))
    decided = walked.select(review, "filename", "reason", F.col("patch_chars").cast("int").alias("patch_chars"))
    return decided.unionByName(files.filter(F.col("reason").isNotNull()))


def scope_summary(decisions: DataFrame, review: str = "review_id") -> DataFrame:
    """Totals per review."""
    selected = F.col("reason").isNull()
    count = lambda condition: F.count(F.when(condition, 1))
    return decisions.groupBy(review).agg(
        (count(~selected) > 0).alias("limited"),
        F.count(F.lit(1)).alias("total_files"),
        count(selected).alias("selected_files"),
        F.coalesce(F.sum(F.when(selected, F.col("patch_chars"))), F.lit(0)).cast("bigint").alias("total_patch_chars"))


def skipped_files(decisions: DataFrame, review: str = "review_id") -> DataFrame:
    """The skipped files as rows: name, reason, size."""
    return decisions.filter(F.col("reason").isNotNull()).select(review, "filename", "reason", "patch_chars")


def scope_document(decisions: DataFrame, limits: Limits = DEFAULT_LIMITS, review: str = "review_id", page: int = 1000) -> DataFrame:
    """The summary with its nested skipped list, in pages of about ``page`` files.

    Page 0 has the totals of the whole review; an ordinary review has only that one. A file's page is
    drawn from its name, so the pages of a review of any size form in different tasks.
    """
    summary = scope_summary(decisions, review).withColumn("pages", F.greatest(
        F.lit(1), F.ceil((F.col("total_files") - F.col("selected_files")) / page)).cast("bigint"))
    skipped = skipped_files(decisions, review).join(summary.select(review, "pages"), review)
    paged = skipped.withColumn("page", F.pmod(F.xxhash64("filename"), F.col("pages")))
    lists = paged.groupBy(review, "page").agg(F.array_sort(F.collect_list(F.struct("filename", "reason", "patch_chars"))).alias("skipped_files"))
    all_pages = summary.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1)))
    return (all_pages.join(lists, [review, "page"], "left")
            .withColumn("skipped_files", F.coalesce(
                "skipped_files", F.array().cast("array<struct<filename:string,reason:string,patch_chars:int>>")))
            .withColumn("max_files", F.lit(limits.max_files))
            .withColumn("max_patch_chars_per_file", F.lit(limits.max_patch_chars_per_file))
            .withColumn("max_total_patch_chars", F.lit(limits.max_total_patch_chars)))


def check_snapshots(before: DataFrame, after: DataFrame, files: DataFrame,
                    limits: Limits = DEFAULT_LIMITS, review: str = "review_id") -> DataFrame:
    """Add ``snapshot_error`` to the first of two header reads around a file listing.

    ``before`` has ``expected_head``, ``head_sha``, ``base_sha``, ``changed_files``;
    ``after`` has ``head_sha``, ``base_sha``, ``changed_files``.
    """
    counts = files.groupBy(review).agg(F.count(F.lit(1)).alias("_listed"))
    later = after.select(review, F.col("head_sha").alias("_head"), F.col("base_sha").alias("_base"),
                         F.col("changed_files").alias("_declared"))
    joined = before.join(later, review, "left").join(counts, review, "left")
    error = (
        F.when(~F.col("head_sha").eqNullSafe(F.col("expected_head")), "head_changed")
        .when(F.col("changed_files") > limits.max_snapshot_files, TOO_MANY)
        .when(~F.col("_head").eqNullSafe(F.col("expected_head")) | ~F.col("_base").eqNullSafe(F.col("base_sha")),
              "head_or_base_changed")
        .when(F.coalesce("_listed", F.lit(0)) != F.col("_declared"), "github_incomplete_files"))
    return joined.withColumn("snapshot_error", error).drop("_head", "_base", "_declared", "_listed")
