"""A reviewer supplied by the user, run over admitted files inside the tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FINDING
from ..sources.shipping import ship_package
from .findings import Rule

# What a reviewer gets: ``file`` (position in the batch), ``filename``, ``line``, ``text``, one row per added line,
# and what it gives back: the finding columns and ``file``, one row per finding.
Review = Callable[[pa.Table], pa.Table]

_FINDINGS = pa.schema([("file", pa.int64()), *[(f.name, pa.int32() if f.name == "line_number" else pa.string()) for f in FINDING.fields]])


class ReviewFailure(Exception):
    """Raised by a reviewer that could not review the files it was given."""

    def __init__(self, code: str, retryable: bool = False) -> None:
        super().__init__(code)
        self.code, self.retryable = code, retryable


def review_files(files: DataFrame, factory: Callable[[], Review], review: str = "review_id") -> DataFrame:
    """Findings and outcomes of a reviewer: one row per finding, or one for a file without any.

    ``files``: review, ``filename``, ``added`` (array of line and text) and, if there is one, ``refused``, a
    code that keeps a file from the reviewer. ``factory`` is called once per task, so that a client or a
    model is set up once. The reviewer gets all added lines of a batch of files as columns; if it fails on
    the batch, it is called again file by file, and only the files it fails on become ``failed`` rows.
    """
    ship_package(files.sparkSession)
    refused = F.col("refused") if "refused" in files.columns else F.lit(None).cast("string")
    narrow = files.select(review, "filename", refused.alias("refused"), "added")
    schema = T.StructType([files.schema[review], T.StructField("filename", T.StringType()), T.StructField("outcome", T.StringType()),
                           T.StructField("error", T.StringType()), T.StructField("retryable", T.BooleanType()), *FINDING.fields])

    def judged(reviewer: Review, lines: pa.Table, wanted: list[int]) -> Iterator[tuple[list[int], pa.Table | None, ReviewFailure | None]]:
        """The findings of these files, or of each alone where the whole cannot be had."""
        try:
            yield wanted, reviewer(lines).select(_FINDINGS.names).cast(_FINDINGS), None
        except ReviewFailure as failure:
            if len(wanted) == 1:
                yield wanted, None, failure
                return
            for file in wanted:
                yield from judged(reviewer, lines.filter(pc.equal(lines["file"], file)), [file])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reviewer = factory()
        for batch in batches:
            codes = batch.column("refused").to_pylist()
            lists = batch.column("added")
            parents, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
            lines = pa.table({"file": parents.cast(pa.int64()), "filename": batch.column("filename").take(parents),
                              "line": flat.field("line"), "text": flat.field("text")})
            admitted = [i for i, code in enumerate(codes) if code is None]
            lines = lines.filter(pc.is_in(lines["file"], pa.array(admitted, pa.int64())))
            out: list[pa.Table] = []
            failures = {i: (code, False) for i, code in enumerate(codes) if code is not None}
            for wanted, found, failure in judged(reviewer, lines, admitted):
                if failure:
                    failures |= {i: (failure.code, failure.retryable) for i in wanted}
                else:
                    out.append(found)
            found = pa.concat_tables(out) if out else _FINDINGS.empty_table()
            bare = sorted(set(range(batch.num_rows)) - set(found["file"].to_pylist()))
            empty = pa.table({"file": pa.array(bare, pa.int64()), **{n: pa.nulls(len(bare), _FINDINGS.field(n).type) for n in _FINDINGS.names[1:]}})
            rows = pa.concat_tables([found, empty]).combine_chunks()
            at = rows["file"].to_pylist()
            columns = [batch.column(review).take(rows["file"].combine_chunks()), batch.column("filename").take(rows["file"].combine_chunks()),
                       pa.array(["failed" if i in failures else "reviewed" for i in at], pa.string()), pa.array([failures.get(i, (None, False))[0] for i in at], pa.string()),
                       pa.array([failures.get(i, (None, False))[1] for i in at], pa.bool_()), *[rows[n].combine_chunks() for n in _FINDINGS.names[1:]]]
            yield pa.record_batch(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


def rule_reviewer(rules: Sequence[Rule]) -> Callable[[], Review]:
    """A reviewer of patterns: a finding for each added line in which a rule's pattern is found."""
    def make() -> Review:
        compiled = [(rule, re.compile(rule.pattern)) for rule in rules]

        def review(lines: pa.Table) -> pa.Table:
            texts, names = lines["text"].to_pylist(), lines["filename"].to_pylist()
            parts = []
            for rule, pattern in compiled:
                hit = pa.array([i for i, (text, name) in enumerate(zip(texts, names)) if name.endswith(rule.suffix) and pattern.search(text)], pa.int64())
                found = lines.take(hit)
                same = lambda value: pa.array([value] * len(hit), pa.string())
                parts.append(pa.table([found["file"], found["filename"], found["line"].cast(pa.int32()), same("ai"), same(rule.id), same(rule.severity),
                                       same(f"Rule {rule.id}"), found["text"], pa.nulls(len(hit), pa.string())], schema=_FINDINGS))
            return pa.concat_tables(parts) if parts else _FINDINGS.empty_table()
        return review
    return make
