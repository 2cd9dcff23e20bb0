"""Scoring findings against labelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signing import stable_id
from .skew import lookup_join

# How analyser rules map to label categories.
BANDIT_CORRECTNESS = ("B110", "B112")
RUFF_QUALITY = ("F401", "F841")

MATCH_KEY = ("file", "line", "category")


def normalize_category(df: DataFrame) -> DataFrame:
    """Replace rule ids by label categories; other sources keep theirs."""
    category, source = F.col("category"), F.col("source")
    mapped = (F.when(source == "bandit", F.when(category.isin(*BANDIT_CORRECTNESS), "correctness").otherwise("security"))
              .when(source == "ruff", F.when(category.isin(*RUFF_QUALITY), "quality").otherwise("correctness"))
              .otherwise(category))
    return df.withColumn("category", mapped)


def match_counts(expected: DataFrame, found: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """``tp``, ``fp``, ``fn`` per ``by``: a one-to-one multiset match on (file, line, category).

    With ``weight``, a row stands for that many equal rows.

    Both sides become rows of one table with a count each, so one aggregation does what a
    join of two would; repeated keys cannot multiply and are combined before the shuffle.
    ``found`` may name the key columns ``file_path`` and ``line_number``.
    """
    renamed = found.withColumnsRenamed({"file_path": "file", "line_number": "line"})
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    side = lambda df, e, f: df.select(
        *by, "file", F.col("line").cast("bigint").alias("line"), "category", (one * e).alias("_e"), (one * f).alias("_f"))
    both = side(expected, 1, 0).unionByName(side(renamed, 0, 1))
    keys = both.groupBy(*by, *MATCH_KEY).agg(F.sum("_e").alias("_e"), F.sum("_f").alias("_f"))
    hit = F.least("_e", "_f")
    return keys.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(F.col("_f") - hit).alias("fp"),
                                 F.sum(F.col("_e") - hit).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Add ``precision``, ``recall`` and ``f1``; null where they are undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return (counts.withColumn("precision", F.try_divide(tp, tp + fp))
            .withColumn("recall", F.try_divide(tp, tp + fn))
            .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn)))


def dedup_first(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """First finding of each (path, line, category) within ``by``."""
    keys = [*by, "file_path", "line_number", "category"]
    rest = [name for name in df.columns if name not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return kept.select(*keys, "_first.*").select(*df.columns)


def combine(first: DataFrame, second: DataFrame, completed: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """First, then second, without repeats, for the cases where the second one completed."""
    ranked = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    kept = lookup_join(ranked, completed.select(*by).distinct(), list(by), how="left_semi")
    return dedup_first(kept, by, ("side", "seq"))


def blocked_status(attempts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``run_status`` and ``run_reason``: what comes after the first failure is not run.

    ``attempts``: ``error`` (null = fine) and the columns of ``order``. The first failure is
    one aggregated row, read as a scalar subquery; there is no global window.
    """
    position = F.struct(*order)
    first = attempts.filter(F.col("error").isNotNull()).agg(
        F.min(F.struct(position.alias("at"), F.col("error").alias("code"))).alias("first")).scalar()
    marked = attempts.withColumn("_first", first)
    later = F.coalesce(position > F.col("_first.at"), F.lit(False))
    return (marked.withColumn("run_status", F.when(later, "not_run").when(F.col("error").isNotNull(), "failed")
                              .otherwise("completed"))
            .withColumn("run_reason", F.when(later, F.col("_first.code")).otherwise(F.col("error"))).drop("_first"))


def experiment_summary(expected: DataFrame, found: DataFrame, status: DataFrame) -> DataFrame:
    """Per experiment: case counts and total scores over its completed cases.

    ``status``: ``experiment``, ``case_id``, ``status``. Labels are matched within a case, so
    equal paths of different cases never meet. Without a completed case the scores are null.
    Equal rows are counted together before any join, so a hot case is as small as its locations.
    """
    done = status.filter(F.col("status") == "completed").select("experiment", "case_id")
    counted = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    labels = counted(expected, ("case_id", *MATCH_KEY)).join(done, "case_id", "inner")
    kept = counted(found, ("experiment", "case_id", "file_path", "line_number", "category")).join(
        done, ["experiment", "case_id"], "left_semi")
    totals = match_counts(labels, kept, ("experiment", "case_id"), "_n").groupBy("experiment").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    cases = status.groupBy("experiment").agg(
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed_cases"),
        F.count(F.lit(1)).alias("total_cases"))
    joined = cases.join(totals, "experiment", "left")
    filled = [F.when(F.col("completed_cases") > 0, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("tp", "fp", "fn")]
    return scores(joined.select("experiment", "completed_cases", "total_cases", *filled))


# Words of 32 bits in a SHA-256 value.
WORDS = 8


def content_digest(name: Column, content: Column) -> Column:
    """Digest of one named file."""
    return stable_id(name, F.sha2(content, 256))


def dataset_fingerprint(df: DataFrame, name: str, content: str, by: Sequence[str] = ()) -> DataFrame:
    """One digest of a whole set of named files, independent of their order.

    An additive multiset hash: the eight words of every file digest are summed up and the
    sums are hashed. Sums combine on the map side, so nothing is sorted or collected and a
    file that occurs twice counts twice, which an exclusive-or would lose.
    """
    digests = df.select(*by, content_digest(F.col(name), F.col(content)).alias("_d"))
    word = lambda i: F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)")
    sums = digests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(word(i)).alias(f"_w{i}") for i in range(WORDS)])
    text = F.concat_ws(",", *[F.coalesce(F.col(f"_w{i}"), F.lit(0)).cast("string") for i in range(WORDS)])
    return sums.select(*by, "files", F.sha2(F.concat(F.col("files").cast("string"), F.lit(":"), text), 256)
                       .alias("fingerprint"))
