"""Words, row-wise Arrow steps and shared tables used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.sources.shipping import ship_package

from . import tokens

# Rows of one step inside a task: small enough that very long texts stay far below a worker's memory.
STEP_ROWS = 512

# Byte table of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased first:
# digits, a-z and every byte of a character beyond ASCII stay, the rest becomes a blank.
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN_WORDS = bytes(_FOLD[b] if _FOLD[b] in _KEEP else 32 for b in range(256))
LOWER = _FOLD


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, Latin letters and non-ASCII characters, as UTF-8 bytes."""
    return text.translate(PLAIN_WORDS).split()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.string()).cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows (a view, nothing is copied)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back(keep_pieces: bool = False) -> None:
    """At a task's end: empty the shared tables and return free memory, since workers wait for the next task."""
    if not keep_pieces:
        tokens.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    ship_package(spark)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Apply ``step`` to small batches; it returns one column (array or list) per field of ``schema``."""
    ship(df.sparkSession)
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in steps(batches):
                columns = step(batch)
                yield pa.record_batch([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]], schema: str,
                  keep_pieces: bool = False) -> DataFrame:
    """Like :func:`map_arrow` for steps that keep state over the batches of a task.

    With ``keep_pieces`` a worker's next task finds the table of token pieces, of bounded size, as this one left it;
    the first task of another kind empties it.
    """
    ship(df.sparkSession)
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in run(steps(batches)):
                yield pa.record_batch([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            give_back(keep_pieces)

    return df.mapInArrow(go, schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows for which ``keep`` says so, all columns as they are."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in steps(batches):
                yield batch.filter(pa.array(keep(batch), pa.bool_()))
        finally:
            give_back()

    return df.mapInArrow(run, df.schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind) if values.type != kind else values
    return pa.array(values, type=kind)


_SIMPLE = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
           "binary": pa.binary(), "float": pa.float32(), "smallint": pa.int16()}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return _SIMPLE[kind.simpleString()]


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no extra column can clash."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
