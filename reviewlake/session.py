"""Session settings the operators are designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Shuffle partitions start high and AQE coalesces them, so a plan does not have to
# know the data size; skewed join partitions are split even if that costs a shuffle.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "reviewlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` entries (dots as ``__``) win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A quiet local session for tests and the benchmark."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        master=f"local[{n}]",
        **{"spark__ui__enabled": "false", "spark__driver__memory": "12g",
           "spark__sql__shuffle__partitions": str(n),
           "spark__ui__showConsoleProgress": "false", **conf},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
