"""Findings: one shape for every source, strict checks, and location checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.binding import let, pin
from ..functions.text import count_lines, escaped_length
from ..limits import DEFAULT_LIMITS, Limits
from ..schemas import FINDING_COLUMNS, SEVERITIES, SOURCES, TEXT_CAPS
from ..sources.folders import stored
from .diff import added_runs, in_runs, parsed_patch
from .scope import walk_budget
from .skew import lookup_join

# Names and codes of analyser output.
SYNTAX_ERROR = "invalid-syntax"
STATIC_SOURCES = ("ruff", "bandit")
RETRYABLE_STATUSES = (408, 429, 500, 502, 503, 504)
INPUT_LIMIT_CODES = ("ai_diff_limit", "ai_file_limit", "ai_total_input_limit")
MIN_RETRY_DELAY = 60


# --- analyser rows -------------------------------------------------------------------

def normalize_ruff(df: DataFrame) -> DataFrame:
    """Rows with ``code, message, fix_message, line_number, file_path`` -> findings."""
    category = F.coalesce(F.when(F.col("code") != "", F.col("code")), F.lit(SYNTAX_ERROR))
    own = ("code", "message", "fix_message")
    return df.select(
        *[c for c in df.columns if c not in own],
        F.lit("ruff").alias("source"), category.alias("category"),
        F.when(category == SYNTAX_ERROR, "medium").otherwise("low").alias("severity"),
        F.concat(F.lit("Ruff "), category).alias("title"),
        F.col("message").alias("description"), F.col("fix_message").alias("suggestion"))


def normalize_bandit(df: DataFrame) -> DataFrame:
    """Rows with ``test_id, test_name, issue_text, issue_severity, line_number, file_path`` -> findings."""
    own = ("test_id", "test_name", "issue_text", "issue_severity")
    return df.select(
        *[c for c in df.columns if c not in own],
        F.lit("bandit").alias("source"), F.col("test_id").alias("category"),
        F.lower("issue_severity").alias("severity"), F.col("test_name").alias("title"),
        F.col("issue_text").alias("description"), F.lit(None).cast("string").alias("suggestion"))


def bandit_batch_status(errors: DataFrame, ruff: DataFrame, review: str = "review_id") -> DataFrame:
    """Per review with file errors: ``bandit_file_error``, or null when all are tolerated.

    An error is tolerated when the other analyser reports a syntax error in that file and
    the reason mentions syntax. ``errors``: review, ``file_path``, ``reason``.
    """
    broken = (ruff.filter(F.col("category") == SYNTAX_ERROR).select(review, "file_path").distinct()
              .withColumn("_broken", F.lit(True)))
    joined = lookup_join(errors, broken, [review, "file_path"])
    excused = F.col("_broken").isNotNull() & F.coalesce(F.lower("reason").contains("syntax"), F.lit(False))
    return joined.groupBy(review).agg(
        F.when(F.bool_or(~excused), "bandit_file_error").alias("status"), F.count(F.lit(1)).alias("errors"))


def static_batch_guard(files: DataFrame, limits: Limits = DEFAULT_LIMITS, review: str = "review_id") -> DataFrame:
    """Per review ``status``: why its static batch cannot run, or null.

    ``files``: ``filename``, ``patch`` and ``content_bytes``. Files are taken in name order and
    the first failing one decides; of files with one name, the second is the duplicate.
    Only counts, codes and one smallest name are aggregated.
    """
    named = (files.select(review, "filename", _file_error(limits).alias("_error"))
             .groupBy(review, "filename").agg(
                 F.count(F.lit(1)).alias("_copies"), F.count(F.col("_error")).alias("_bad"),
                 F.min("_error").alias("_error")))
    code = (F.when(F.col("_bad") == F.col("_copies"), F.col("_error"))
            .when(F.col("_copies") > 1, "analyzer_duplicate_filename"))
    return (named.withColumn("_code", code).groupBy(review).agg(
        F.when(F.sum("_copies") > limits.max_files, "analyzer_file_limit")
        .otherwise(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("filename")))).alias("status"),
        F.sum("_copies").cast("bigint").alias("files")))


def _file_error(limits: Limits) -> Column:
    outside = ~F.col("filename").endswith(".py") | (F.col("content_bytes") > limits.max_source_bytes_per_file)
    error = parsed_patch(F.coalesce(F.col("patch"), F.lit("")))["error"]
    return F.when(outside, "analyzer_source_limit").otherwise(error)


def on_changed_lines(findings: DataFrame, changed: DataFrame, review: str = "review_id") -> DataFrame:
    """Findings on added lines. ``changed``: review, ``filename``, ``line``."""
    lines = changed.select(review, F.col("filename").alias("file_path"), F.col("line").alias("line_number"))
    return lookup_join(findings, lines, [review, "file_path", "line_number"], how="left_semi")


def static_status(findings: DataFrame, review: str = "review_id") -> DataFrame:
    """Per review: does any analyser row break the row schema (then all of them are void)?"""
    static = findings.filter(F.col("source").isin(*STATIC_SOURCES))
    return static.groupBy(review).agg(
        F.bool_or(~row_ok(strict=False)).alias("failed"), F.count(F.lit(1)).alias("rows"))


def void_failed(findings: DataFrame, status: DataFrame, review: str = "review_id") -> DataFrame:
    """Findings without the analyser rows of failed reviews."""
    failed = status.filter("failed").select(review)
    static = findings.filter(F.col("source").isin(*STATIC_SOURCES))
    rest = findings.filter(~F.col("source").isin(*STATIC_SOURCES))
    return lookup_join(static, failed, [review], how="left_anti").unionByName(rest)


# --- strict rows ----------------------------------------------------------------------

def row_ok(strict: bool = True) -> Column:
    """Row test on typed finding columns; ``strict`` adds the length caps."""
    ok = (F.col("line_number") > 0) & F.col("source").isin(*SOURCES) & F.col("severity").isin(*SEVERITIES)
    for name, cap in TEXT_CAPS.items():
        if name == "suggestion":
            if strict:
                ok = ok & (F.col(name).isNull() | (F.length(name) <= cap))
        else:
            ok = ok & (F.length(name).between(1, cap) if strict else F.col(name).isNotNull())
    return F.coalesce(ok, F.lit(False))


def strict_rows(df: DataFrame) -> DataFrame:
    """Add ``schema_ok`` to typed finding rows."""
    return df.withColumn("schema_ok", row_ok())


def strict_schema(df: DataFrame, item: str = "item", ai: bool = False) -> DataFrame:
    """Add typed finding columns and ``schema_ok`` from a VARIANT column of one finding.

    No coercion and no extra keys; with ``ai`` the suggestion is required and not empty.
    ``ai_schema_ok`` is what :func:`item_ok` says, from the same columns.
    """
    opened = pin(df, _members=V.members(F.col(item)))
    held = F.col("_members")
    typed = pin(opened, **{
        name: V.as_whole(held[name], "int") if name == "line_number" else V.as_text(held[name])
        for name in FINDING_COLUMNS})
    return typed.withColumns({
        "schema_ok": F.coalesce(_known_keys(held) & _suggestion_ok(held, ai) & row_ok(), F.lit(False)),
        "ai_schema_ok": _members_ok(held, {name: F.col(name) for name in TEXT_CAPS})}).drop("_members")


def _known_keys(held: Column) -> Column:
    extra = F.array_except(F.map_keys(held), F.array(*[F.lit(name) for name in FINDING_COLUMNS]))
    return F.size(extra) == 0


def _suggestion_ok(held: Column, ai: bool) -> Column:
    suggestion = held["suggestion"]
    if ai:
        return F.coalesce(F.length(V.as_text(suggestion)) >= 1, F.lit(False))
    return V.is_absent(suggestion) | V.is_text(suggestion)


def check_envelope(df: DataFrame, raw: str = "raw", finish: str | None = "finish_reason",
                   limits: Limits = DEFAULT_LIMITS, document: str | None = None) -> DataFrame:
    """Add ``items`` (array of VARIANT) and ``envelope_error`` for a model answer.

    One key ``findings`` that is a list, within the count limit; anything around the JSON,
    a code fence too, makes it invalid. ``document`` names a column for the parsed answer, if it is wanted.
    """
    parsed = pin(df, _doc=V.parse(F.col(raw)))
    opened = pin(parsed, _members=V.members(F.col("_doc")))
    listed = pin(opened, items=V.elements(F.col("_members")["findings"]))
    sole = (F.size("_members") == 1) & F.col("items").isNotNull()
    finished = F.lit(True) if finish is None else F.col(finish) == "STOP"
    error = (F.when(~F.coalesce(finished, F.lit(False)), "ai_incomplete_response")
             .when(F.col("_doc").isNull(), "invalid_json")
             .when(~F.coalesce(sole, F.lit(False)), "invalid_response_envelope")
             .when(F.size("items") > limits.max_findings_per_response, "ai_invalid_response"))
    checked = listed.withColumn("envelope_error", error)
    return (checked.withColumn(document, F.col("_doc")) if document else checked).drop(*{"_doc", "_members"} - {document})


def explode_items(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per finding of each sound answer: keys, ``pos``, ``item``."""
    sound = F.when(F.col("envelope_error").isNull(), F.col("items"))
    return df.select(*keys, F.posexplode(sound).alias("pos", "item"))


# --- locations ------------------------------------------------------------------------

def reviewed_files(files: DataFrame, review: str = "review_id") -> DataFrame:
    """Per file: ``file_path``, ``line_count``, ``added`` (sorted runs of added lines).

    A row per file with a few runs keeps both the patch text and the single lines out of the join.
    ``files`` needs ``line_count`` or ``text``.
    """
    count = F.col("line_count") if "line_count" in files.columns else count_lines(F.col("text"), "bytes")
    return files.select(review, F.col("filename").alias("file_path"), count.cast("int").alias("line_count"),
                        added_runs(F.col("patch")).alias("added"))


def validate_findings(findings: DataFrame, files: DataFrame, review: str = "review_id") -> DataFrame:
    """Add ``reason`` (null = accepted): the first failing check of each finding.

    ``files`` comes from :func:`reviewed_files`. Siblings of a bad row survive. One join brings a file's
    line count and runs to its findings; a line is looked up in the runs there.
    """
    # The row is judged before it travels, so texts that nobody reads later stay behind.
    judged = findings.withColumn("_row_ok", row_ok())
    joined = lookup_join(judged, files.select(review, "file_path", "line_count", "added"), [review, "file_path"])
    reason = (F.when(~F.col("_row_ok"), "invalid_schema").when(F.col("line_count").isNull(), "unknown_file")
              .when(F.col("line_number") > F.col("line_count"), "invalid_line_number")
              .when(~F.coalesce(in_runs(F.col("added"), F.col("line_number")), F.lit(False)), "outside_reviewed_changes"))
    return joined.withColumn("reason", reason).select(*findings.columns, "reason")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame, review: str = "review_id") -> DataFrame:
    """Index and reason of each refused finding."""
    return validated.filter(F.col("reason").isNotNull()).select(review, F.col("idx").alias("index"), "reason")


def validate_model_responses(responses: DataFrame, files: DataFrame, keys: Sequence[str] = ("review_id", "file_path"),
                             limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per answer with ``findings_count`` and ``error``: one bad row voids the whole answer.

    ``responses``: keys, ``raw``, ``finish_reason``; ``file_path`` is the file the answer is
    about. An answer is one row with at most ``max_findings_per_response`` items, so its items
    are judged inside the row.
    """
    # What the items say is read once, before the join, so neither they nor the answer travel.
    path, shape = F.col(keys[-1]), f"OBJECT<findings: ARRAY<{_ITEM_SHAPE}>>"
    checked = pin(check_envelope(responses, limits=limits, document="_doc"), _shape=V.type_of(F.col("_doc")))
    listed = f"findings array<struct<{', '.join(f'{name}: {kind}' for name, kind in _ITEM_TYPES.items())}>>"

    def judged(item: Column) -> Column:
        own = (item["source"] == "ai") & (item["file_path"] == path)
        return F.struct(_typed_ok(item).alias("ok"), F.coalesce(own, F.lit(False)).alias("own"), item["line_number"].alias("line"))

    # Items of another shape are not read: one of them at least is not sound, and null stands for them all.
    items = (F.when(F.col("envelope_error").isNotNull(), None).when(F.size("items") == 0, F.array())
             .when(F.col("_shape") == shape, F.transform(F.from_json("raw", listed)["findings"], judged)))
    opened = checked.withColumn("_judged", items).drop("items", "_doc", "_shape")
    located = lookup_join(opened, files, list(keys))
    items = F.col("_judged")
    off = F.exists(items, lambda item: ~F.coalesce(
        item["own"] & (item["line"] <= F.col("line_count")) & in_runs(F.col("added"), item["line"]), F.lit(False)))
    error = (F.when(F.col("envelope_error") == "ai_incomplete_response", F.col("envelope_error"))
             .when(F.col("envelope_error").isNotNull() | items.isNull() | F.exists(items, lambda item: ~item["ok"]), "ai_invalid_response")
             .when(off, "ai_invalid_location"))
    return (located.withColumn("error", error)
            .withColumn("findings_count", F.when(F.col("error").isNull(), F.size(items)))
            .drop("_judged", "envelope_error", "line_count", "added"))


# The members of a sound item and, from them, what the type test says of it: neither a key nor a type may differ.
_ITEM_TYPES = {name: "bigint" if name == "line_number" else "string" for name in FINDING_COLUMNS}
_ITEM_SHAPE = f"OBJECT<{', '.join(f'{name}: {_ITEM_TYPES[name].upper()}' for name in sorted(_ITEM_TYPES))}>"


def item_ok(item: Column) -> Column:
    """Strict model-finding test on a VARIANT, as one expression (usable inside a lambda)."""
    return F.coalesce(let(V.members(item), lambda held: _members_ok(held)), F.lit(False))


def _members_ok(held: Column, texts: dict[str, Column] | None = None) -> Column:
    """The test on an item's members; ``texts`` has those that are read already."""
    text = lambda name: texts[name] if texts and name in texts else V.as_text(held[name])
    return F.coalesce(_known_keys(held) & _values_ok(V.as_whole(held["line_number"]), text), F.lit(False))


def _typed_ok(item: Column) -> Column:
    """The same test on an item whose keys and types are known to be right; a null is a missing member."""
    return F.coalesce(_values_ok(item["line_number"], lambda name: item[name]), F.lit(False))


def _values_ok(line: Column, text: Callable[[str], Column]) -> Column:
    ok = line > 0
    for name, cap in TEXT_CAPS.items():
        ok = ok & F.length(text(name)).between(1, cap)
    return ok & text("source").isin(*SOURCES) & text("severity").isin(*SEVERITIES)


# --- model input ------------------------------------------------------------------------

def model_requests(files: DataFrame, repository: str = "repository_name", overhead: int = 0) -> DataFrame:
    """Add ``request`` (JSON) and ``cost``: characters of the record with non-ASCII escaped.

    ``overhead`` stands for fixed text sent with each request, such as instructions.
    """
    fields = [F.col(repository).alias("repository_name"), F.col("filename").alias("file_path"),
              F.coalesce(F.col("patch"), F.lit("")).alias("patch"), F.col("text").alias("context")]
    # {"a": , ...}: braces, quotes around keys and values, colons and commas.
    frame = sum(len(name) + 6 for name in ("repository_name", "file_path", "patch", "context")) + 1
    cost = sum((escaped_length(c) for c in fields), F.lit(frame + overhead))
    return files.withColumn("request", F.to_json(F.struct(*fields))).withColumn("cost", cost.cast("bigint"))


def admit_model_inputs(files: DataFrame, limits: Limits = DEFAULT_LIMITS, review: str = "review_id") -> DataFrame:
    """Per file ``reason`` (null = admitted), walking each review's files in name order.

    ``files``: ``filename``, ``patch_chars``, ``cost``, ``attempts`` (calls made if admitted).
    Suffix and diff size are decided per row; the two budgets as in :func:`scope.walk_budget`, where a
    file must fit with all its retries and uses up the calls it made.
    """
    reason = (F.when(~F.col("filename").endswith(".py"), "ai_unsupported_file")
              .when(F.col("patch_chars") > limits.ai_max_diff_chars, "ai_diff_limit"))
    judged = stored(files.select(review, "filename", "cost", "attempts", reason.alias("reason")), "judged")
    walked = walk_budget(judged.filter(F.col("reason").isNull()), review, "filename", "cost",
                         F.col("cost") * F.col("attempts"), 1 + limits.ai_max_retries, limits.ai_max_files,
                         limits.ai_max_total_input_chars, ("ai_file_limit", "ai_total_input_limit"))
    attempts = F.when(F.col("cost") > 0, F.col("_used") / F.col("cost")).otherwise(0).cast(files.schema["attempts"].dataType)
    decided = walked.select(review, "filename", F.col("cost").cast(files.schema["cost"].dataType).alias("cost"), attempts.alias("attempts"), "reason")
    return decided.unionByName(judged.filter(F.col("reason").isNotNull()))


def usage(df: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Token counters summed per key; null when no call of the key has the counter."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in counters])


def file_outcomes(df: DataFrame) -> DataFrame:
    """Add ``outcome``, ``outcome_reason`` and ``retryable`` from ``error`` and ``encoding_ok``.

    Only the three limit codes and the encoding are named; every other error is one
    generic failure.
    """
    error = F.col("error")
    skipped = ~F.col("encoding_ok") | error.isin(*INPUT_LIMIT_CODES)
    failed = error.isNotNull() & ~skipped
    return (df.withColumn("outcome", F.when(F.coalesce(skipped, F.lit(False)), "skipped")
                          .when(error.isNotNull(), "failed").otherwise("reviewed"))
            .withColumn("outcome_reason", F.when(~F.col("encoding_ok"), "ai_source_encoding")
                        .when(error.isin(*INPUT_LIMIT_CODES), error).when(error.isNotNull(), "ai_review_failed"))
            .withColumn("retryable", F.coalesce(failed & ai_retryable(error), F.lit(False))))


def ai_retryable(error: Column) -> Column:
    codes = [f"ai_http_{status}" for status in RETRYABLE_STATUSES]
    return F.coalesce(error.isin("ai_transport_error", *codes), F.lit(False))


def classify_errors(df: DataFrame) -> DataFrame:
    """Add ``error``, ``retryable`` and ``retry_after`` to answered calls.

    ``df``: ``service`` (ai or github), ``http_status`` (null = no answer),
    ``rate_remaining``, ``rate_reset``, ``retry_after_header`` (text), ``body`` and ``now_epoch``.
    """
    status, service = F.col("http_status"), F.col("service")
    spent = F.coalesce(F.col("rate_remaining") == "0", F.lit(False))
    limited = spent | F.col("retry_after_header").isNotNull() | F.coalesce(
        F.lower("body").contains("rate limit"), F.lit(False))
    error = (F.when(status.isNull() & (service == "ai"), "ai_transport_error")
             .when(status.isNull(), "github_unavailable")
             .when((service == "ai") & (status != 200), F.concat(F.lit("ai_http_"), status.cast("string")))
             .when((service == "github") & (status >= 400), F.concat(F.lit("github_http_"), status.cast("string"))))
    github = status.isin(408, 429) | (status >= 500) | ((status == 403) & limited)
    retryable = F.when(status.isNull(), True).when(service == "ai", status.isin(*RETRYABLE_STATUSES)).otherwise(github)
    # A header that is no whole number ends the reading of headers, as a parse error would.
    header = F.col("retry_after_header")
    asked = F.btrim(header).try_cast("bigint")
    until_reset = F.when(spent & (header.isNull() | asked.isNotNull()),
                         F.coalesce("rate_reset", F.lit("0")).try_cast("bigint") - F.col("now_epoch") + 1)
    delay = F.greatest(F.lit(MIN_RETRY_DELAY).cast("bigint"), asked, until_reset)
    return (df.withColumn("error", error).withColumn("retryable", F.coalesce(retryable, F.lit(False)))
            .withColumn("retry_after", F.when(F.col("retryable") & (service == "github") & status.isNotNull(), delay)))


def component_status(df: DataFrame) -> DataFrame:
    """Add ``ai_status``, ``retry_ai`` and ``final_status`` to one row per review.

    ``df``: ``ai_enabled``, ``ai_failed`` and ``ai_skipped`` (file counts), ``ai_transient``,
    ``static_failed``, ``attempt_count``.
    """
    ai = (F.when(~F.col("ai_enabled"), "disabled").when(F.col("ai_failed") > 0, "failed")
          .when(F.col("ai_skipped") > 0, "limited").otherwise("completed"))
    return (df.withColumn("ai_status", ai)
            .withColumn("retry_ai", F.col("ai_enabled") & F.col("ai_transient") & (F.col("attempt_count") < 4))
            .withColumn("final_status", F.when(F.col("retry_ai"), "queued")
                        .when(F.col("static_failed") | (F.col("ai_status") == "failed"), "failed")
                        .otherwise("completed")))


# --- line rules ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str = "low"
    suffix: str = ""


def scan_rules(lines: DataFrame, rules: Sequence[Rule], path: str = "filename") -> DataFrame:
    """One row per (line, rule) whose pattern is found in the text of an added line.

    The rules are part of the expression: one pass over the lines, no join. This applies
    the given patterns and claims nothing about what a linter would find.
    """
    matches = [F.when(F.col(path).endswith(rule.suffix) & F.col("text").rlike(rule.pattern),
                      F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity")))
               for rule in rules]
    hits = F.explode(F.array_compact(F.array(*matches)))
    return lines.filter(F.col("kind") == "added").withColumn("_hit", hits).select(
        *lines.columns, F.col("_hit.rule_id").alias("rule_id"), F.col("_hit.severity").alias("severity"))
