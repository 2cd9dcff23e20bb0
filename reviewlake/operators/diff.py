"""Unified diffs as a relation.

A patch is one row, so everything about it is computed inside that row: split it,
cut it into hunks, number both sides. The position of a line among the lines of its
own side *is* its number, so no window, no sort and no shuffle is needed, and a
review that holds a third of all patches is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import count_lines, split_lines

# The format of a hunk header and the end-of-file marker.
HUNK_HEADER = r"(?s)\A@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@.*\z"
NO_NEWLINE = "\\ No newline at end of file"

# Error codes of a patch.
INCOMPLETE, BAD_HEADER, BAD_POSITION = "incomplete_diff_hunk", "invalid_diff_hunk", "invalid_diff_position"
OVERLAP, BAD_BODY, BAD_COUNTS = "overlapping_diff_hunks", "invalid_diff_body", "invalid_diff_counts"

KEYS = ("review_id", "filename")
_NEVER = 2**31 - 1
# Header numbers are decimals, so that no patch can overflow; longer ones count as the largest.
_DIGITS = 37


def _kind(line: Column) -> Column:
    return (F.when(line.startswith("+"), "added").when(line.startswith("-"), "removed")
            .when(line.startswith(" "), "context").when(line == NO_NEWLINE, "marker").otherwise("bad"))


def _number(header: Column, group: int, default: str | None = None) -> Column:
    found = F.regexp_extract(header, HUNK_HEADER, group)
    if default is not None:
        found = F.when((found == "") & header.rlike(HUNK_HEADER), default).otherwise(found)
    digits = F.regexp_replace(found, "^0+(?=.)", "")
    return F.when(F.length(digits) > _DIGITS, F.lit("9" * _DIGITS)).otherwise(digits).try_cast("decimal(38,0)")


def _numbered(start: Column, i: Column) -> Column:
    """Number of the i-th line of a side, null beyond BIGINT."""
    return F.try_add(start.try_cast("bigint"), i.cast("bigint"))


def _cut(lines: Column) -> Column:
    """Hunks of a patch: header fields plus the body as (pos, kind, text)."""
    heads = F.filter(F.transform(lines, lambda line, i: F.when(line.startswith("@@"), i)), lambda i: i.isNotNull())

    def hunk(lines: Column, heads: Column, at: Column, no: Column) -> Column:
        header = F.get(lines, at)
        following = F.coalesce(F.get(heads, no + 1), F.size(lines))
        body = F.transform(
            F.slice(lines, at + 2, following - at - 1),
            lambda line, i: F.struct((at + 1 + i).alias("pos"), _kind(line).alias("kind"), line.alias("text")),
        )
        return F.struct(
            no.alias("hunk"), at.alias("pos"), header.alias("header"),
            _number(header, 1).alias("old_start"), _number(header, 2, "1").alias("old_count"),
            _number(header, 3).alias("new_start"), _number(header, 4, "1").alias("new_count"),
            body.alias("body"),
        )

    return let(heads, lambda h: F.transform(h, lambda at, no: hunk(lines, h, at, no)))


def _side(body: Column, own: str) -> Column:
    return F.filter(body, lambda e: e["kind"].isin(own, "context"))


def _measure(hunk: Column) -> Column:
    """What the error rules need to know about one hunk, in one small struct."""
    def measured(old: Column, new: Column) -> Column:
        # The first line beyond a declared count is the one that breaks it.
        within = lambda count: F.least(count, F.lit(_NEVER).cast("decimal(38,0)")).cast("int")
        too_old = F.get(old, within(hunk["old_count"]))["pos"]
        too_new = F.get(new, within(hunk["new_count"]))["pos"]
        bad = F.get(F.filter(hunk["body"], lambda e: e["kind"] == "bad"), F.lit(0))["pos"]
        return F.struct(
            hunk["pos"].alias("pos"),
            hunk["old_start"].alias("old"), hunk["new_start"].alias("new"),
            hunk["old_count"].alias("old_count"), hunk["new_count"].alias("new_count"),
            ((F.size(old) < hunk["old_count"]) | (F.size(new) < hunk["new_count"])).alias("short"),
            F.coalesce(bad, F.lit(_NEVER)).alias("bad"),
            F.least(F.coalesce(too_old, F.lit(_NEVER)), F.coalesce(too_new, F.lit(_NEVER))).alias("excess"),
        )
    return let(_side(hunk["body"], "removed"), lambda old: let(_side(hunk["body"], "added"), lambda new: measured(old, new)))


def _first_error(lines: Column, hunks: Column) -> Column:
    """The error at the smallest line position; null for a sound patch."""
    at_line = lambda pos, code: F.struct(pos.alias("pos"), code.alias("code"))

    def at_header(h: Column, prev: Column) -> Column:
        broken = h["old"].isNull() | h["new"].isNull() | h["old_count"].isNull() | h["new_count"].isNull()
        misplaced = ((h["old_count"] > 0) & (h["old"] < 1)) | ((h["new_count"] > 0) & (h["new"] < 1))
        overlap = (h["old"] < prev["old"] + prev["old_count"]) | (h["new"] < prev["new"] + prev["new_count"])
        return (F.when(F.coalesce(prev["short"], F.lit(False)), INCOMPLETE)
                .when(broken, BAD_HEADER).when(misplaced, BAD_POSITION)
                .when(F.coalesce(overlap, F.lit(False)), OVERLAP))

    def candidates(measures: Column) -> Column:
        headers = F.transform(measures, lambda h, i: at_line(h["pos"], at_header(h, F.get(measures, i - 1))))
        bodies = F.transform(measures, lambda h: at_line(
            F.least(h["bad"], h["excess"]),
            F.when(h["bad"] < h["excess"], BAD_BODY).when(h["excess"] < F.lit(_NEVER), BAD_COUNTS)))
        leading = F.when(F.coalesce(~F.get(lines, F.lit(0)).startswith("@@"), F.lit(False)), BAD_BODY)
        unfinished = F.coalesce(F.try_element_at(measures, F.lit(-1))["short"], F.lit(True))
        ends = F.array(at_line(F.lit(0), leading), at_line(F.size(lines), F.when(unfinished, INCOMPLETE)))
        return F.filter(F.concat(headers, bodies, ends), lambda e: e["code"].isNotNull())

    return let(F.transform(hunks, _measure), lambda m: F.array_min(candidates(m))["code"])


def parsed_patch(patch: Column) -> Column:
    """``struct<error, hunks>`` of a patch; ``hunks`` is null when there is an error."""
    def judged(lines: Column, hunks: Column) -> Column:
        return let(_first_error(lines, hunks), lambda error: F.struct(
            error.alias("error"), F.when(error.isNull(), hunks).alias("hunks")))
    return let(split_lines(patch), lambda lines: let(_cut(lines), lambda hunks: judged(lines, hunks)))


def added_numbers(patch: Column) -> Column:
    """Sorted new-side numbers of the added lines, as an array; null for an unsound or absent patch."""
    def of_hunk(hunk: Column) -> Column:
        numbered = F.transform(_side(hunk["body"], "added"), lambda e, i: F.struct(
            e["kind"].alias("kind"), _numbered(hunk["new_start"], i).alias("line")))
        return F.transform(F.filter(numbered, lambda e: e["kind"] == "added"), lambda e: e["line"])
    return let(parsed_patch(patch), lambda p: F.flatten(F.transform(p["hunks"], of_hunk)))


def added_text(patch: Column) -> Column:
    """Added lines of a sound patch as ``(line, text)``, in order; null for an unsound or absent one."""
    def of_hunk(hunk: Column) -> Column:
        numbered = F.transform(_side(hunk["body"], "added"), lambda e, i: F.struct(
            e["kind"].alias("kind"), _numbered(hunk["new_start"], i).alias("line"), e["text"].alias("text")))
        return F.transform(F.filter(numbered, lambda e: e["kind"] == "added"), lambda e: F.struct(e["line"].alias("line"), e["text"].alias("text")))
    return let(parsed_patch(patch), lambda p: F.flatten(F.transform(p["hunks"], of_hunk)))


def added_runs(patch: Column) -> Column:
    """The same lines as sorted runs ``(first, last)`` of neighbours: a hunk of added lines is one entry,
    however long, and runs of adjoining hunks are one. Null for an unsound or absent patch."""
    def runs(numbers: Column) -> Column:
        begins = F.filter(numbers, lambda n, i: F.coalesce(F.get(numbers, i - 1) != n - 1, F.lit(True)))
        ends = F.filter(numbers, lambda n, i: F.coalesce(F.get(numbers, i + 1) != n + 1, F.lit(True)))
        return F.zip_with(begins, ends, lambda first, last: F.struct(first.alias("first"), last.alias("last")))
    return let(added_numbers(patch), runs)


def in_runs(runs: Column, line: Column) -> Column:
    """Is the line in one of the runs? Binary search for the last run that does not begin after it.

    The place grows by falling powers of two while the run there begins early enough, so a line costs as
    many steps as the number of runs has bits. Null where there are no runs to look into.
    """
    powers = F.transform(F.sequence(F.ceil(F.log2(F.size(runs) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    place = F.aggregate(powers, F.lit(-1), lambda at, step: F.when(F.get(runs, at + step)["first"] <= line, at + step).otherwise(at))
    return F.when(runs.isNotNull(), F.coalesce(let(place, lambda at: F.get(runs, at)["last"] >= line), F.lit(False)))


def patch_lines(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per patch line: keys, 0-based ``pos``, ``text``."""
    return files.select(*keys, F.posexplode(split_lines(F.col(patch))).alias("pos", "text"))


def hunks(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per hunk header, sound or not; an omitted count is 1, an unreadable header has nulls,
    a number beyond BIGINT is null."""
    cut = files.select(*keys, F.explode(let(split_lines(F.col(patch)), _cut)).alias("h"))
    numbers = [F.col(f"h.{n}").try_cast("bigint").alias(n) for n in ("old_start", "old_count", "new_start", "new_count")]
    return cut.select(*keys, "h.hunk", "h.pos", *numbers)


def diff_errors(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys and ``error``, the first error of each patch, null when there is none."""
    return files.filter(F.col(patch).isNotNull()).select(*keys, parsed_patch(F.col(patch))["error"].alias("error"))


def diff_lines(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every body line of every sound patch with ``kind``, ``old_line``, ``new_line`` and ``text``."""
    def numbered(hunk: Column) -> Column:
        row = lambda e, old, new: F.struct(
            hunk["hunk"].alias("hunk"), e["pos"].alias("pos"), e["kind"].alias("kind"),
            old.alias("old_line"), new.alias("new_line"), e["text"].alias("text"))
        none = F.lit(None).cast("bigint")
        old = F.transform(_side(hunk["body"], "removed"), lambda e, i: row(e, _numbered(hunk["old_start"], i), none))
        new = F.transform(_side(hunk["body"], "added"), lambda e, i: row(e, none, _numbered(hunk["new_start"], i)))

        def merged(old: Column, new: Column) -> Column:
            own = lambda side, kind: F.filter(side, lambda e: e["kind"] == kind)
            shared = F.zip_with(own(old, "context"), own(new, "context"),
                                lambda o, n: row(o, o["old_line"], n["new_line"]))
            return F.concat(own(old, "removed"), own(new, "added"), shared)
        return let(old, lambda o: let(new, lambda n: merged(o, n)))

    parsed = files.select(*keys, F.explode(parsed_patch(F.col(patch))["hunks"]).alias("h"))
    lines = parsed.select(*keys, F.explode(numbered(F.col("h"))).alias("line"))
    return lines.select(*keys, "line.*")


def changed_lines(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distinct line sets of sound patches: keys, ``side`` (added, new, removed), ``line``.

    The numbers of one side of one patch rise strictly, so they are distinct already.
    """
    lines = diff_lines(files, patch, keys)
    sides = F.when(F.col("kind") == "added", F.array(F.lit("added"), F.lit("new"))) \
        .when(F.col("kind") == "context", F.array(F.lit("new"))).otherwise(F.array(F.lit("removed")))
    return (lines.select(*keys, "old_line", "new_line", F.explode(sides).alias("side"))
            .select(*keys, "side", F.when(F.col("side") == "removed", F.col("old_line"))
                    .otherwise(F.col("new_line")).alias("line")))


def added_lines(files: DataFrame, patch: str = "patch", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys and ``line`` of each added line of a sound patch."""
    return files.select(*keys, F.explode(added_numbers(F.col(patch))).alias("line"))


def full_file_patch(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``patch``: the whole file as one hunk of added lines."""
    def build(lines: Column) -> Column:
        body = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("+"), line)), "\n")
        return F.concat(F.lit("@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), body)
    return df.withColumn("patch", let(split_lines(F.col(text)), build))


def file_line_counts(df: DataFrame, content: str = "text", mode: str = "text") -> DataFrame:
    """Add ``line_count``; ``mode`` is ``text`` (every separator) or ``bytes`` (LF, CR, CRLF)."""
    return df.withColumn("line_count", count_lines(F.col(content), mode))
