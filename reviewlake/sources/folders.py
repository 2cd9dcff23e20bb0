"""Where streams and cut lineages keep their files."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders made by this process, by the session's application, to be removed when it ends.
_MADE: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``; it goes when the program ends.

    Without that setting a local session gets a temporary folder; a cluster session must
    name a folder all its machines can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _LOCAL.setdefault("base", tempfile.mkdtemp(prefix="reviewlake-"))
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    application = getattr(spark.sparkContext, "applicationId", None)
    if application:
        if application not in _MADE:
            _MADE[application] = []
            atexit.register(_remove, spark, application)
        _MADE[application].append(path)
    return path


def _remove(spark: SparkSession, application: str) -> None:
    """Delete what was made here through the store's own file system, while the session is still there."""
    with contextlib.suppress(Exception):  # the session may be gone; then its folders stay
        jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _MADE.pop(application, []):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(configuration).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete the folders made so far; for a program that stops its session before it ends."""
    _remove(spark, spark.sparkContext.applicationId)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a written table in the shared folder.

    For a result that several later steps read: it is computed once, also when executors are
    lost, since what is read afterwards is a table and not a lineage.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
