"""Writers that stay correct when a job is repeated or a task is lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.policy import safe_error
from .manifest import BucketTable

# Buckets of a new findings table; a review is always in the same one. The number is stored with the table.
BUCKETS = 256


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is none yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_findings(spark: SparkSession, path: str, review: str = "review_id") -> DataFrame | None:
    """The rows of a table that :func:`write_findings` wrote, or None when there is none yet."""
    return BucketTable(spark, path, [review]).read()


def write_findings(findings: DataFrame, reviews: DataFrame, path: str, review: str = "review_id",
                   buckets: int = BUCKETS) -> None:
    """Replace all findings of ``reviews`` (also with none) in a table bucketed by review.

    Findings of a review that ``reviews`` does not name are not written: they would stand beside that
    review's own ones, or for them. What is moved and written are the new findings and the names of the
    reviews: a reader leaves earlier findings of those reviews out, and only a bucket that has gathered too
    many folders is read and written again. The manifest names all of it together. So a reader sees all of
    a call or nothing of it, a call that died is repeated as it was, and a repeated call writes the same
    rows again.
    """
    spark = findings.sparkSession
    table = BucketTable(spark, path, [review], buckets)
    named = reviews.select(F.col(review).cast(findings.schema[review].dataType).alias(review)).distinct()
    touched = table.touched(named)
    if not touched:
        return
    fresh = findings.join(named, review, "left_semi").select(*findings.columns)
    if table.state["schema"] is None:
        table.commit(table.write(fresh, "findings"), (), fresh.schema)
        return
    known = T.StructType.fromJson(table.state["schema"])
    schema = fresh.unionByName(spark.createDataFrame([], known), allowMissingColumns=True).schema
    same_types = all(schema[f.name].dataType == f.dataType for f in known)
    merged = table.crowded(touched) if same_types else touched
    marked = [b for b in touched if b not in set(merged) and str(b) in table.state["folders"]]
    fresh = fresh.unionByName(table.read(merged).join(named, review, "left_anti") if merged else spark.createDataFrame([], known), allowMissingColumns=True)
    removed = table.write(named.filter(table.bucket().isin(marked)), "removed") if marked else []
    table.commit(table.write(fresh, "findings"), merged, schema, removed)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result documents, one JSON object per row."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


# The fields of a log record.
LOG_FIELDS = ("review_id", "repository", "pull_request", "head_sha", "worker", "stage", "duration", "error")


def stage_log(events: DataFrame) -> DataFrame:
    """Log records with a closed set of fields; errors are reduced to codes that may be shown."""
    return events.select(
        "review_id", F.col("repository_name").alias("repository"), F.col("pull_request_number").alias("pull_request"),
        "head_sha", "worker", "stage", "duration",
        F.when(F.col("error").isNotNull(), safe_error(F.col("error"))).alias("error"))


def to_json_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as JSON text in one ``value`` column, for line-oriented sinks."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value"))
