"""Helpers shared by the operators: the shared folder, written intermediates, row keys and sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII white-space characters, for translate().
SPACES = " \t\n\x0b\f\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            named = own.get()
        else:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tickframe-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Shuffle files of a finished execution are deleted at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_scopes: list[list[str]] = []


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's settings within; for what is executed within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(rows: int, size: int) -> dict[str, object]:
    """Settings under which Spark hands Python at most so many rows and about so many bytes at a time."""
    return {ARROW_ROWS: rows, ARROW_BYTES: size}


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, those written within an inner scratch already then. A table that must stay is written
    outside: its readers are lazy."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), batches: dict[str, object] | None = None, result: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing that was written.

    The table belongs to the innermost scratch that is open; without one it stays until its owner deletes the folder. A result
    outlives the innermost scratch and belongs to the one around it. batches: see arrow_batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > result:
        _scopes[-1 - result].append(path)
    with settings(spark, {CLEANUP: "true"} | (batches or {})):
        to = df.write.option("compression", "zstd")
        (to.partitionBy(*partition_by) if partition_by else to).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, before their scratch ends."""
    for table in tables:
        path = table._written_to
        drop(table.sparkSession, path)
        for scope in _scopes:
            if path in scope:
                scope.remove(path)


@cache
def _c_library() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(-3, 1 << 20)  # arrays of a megabyte or more go back to the system when they are freed
        return library
    except (OSError, AttributeError):  # another system: it does as it does
        return None


def give_back() -> None:
    """Returns this Python worker's free memory to the system: workers wait for their next task beside others that work."""
    pa.default_memory_pool().release_unused()
    if library := _c_library():
        library.malloc_trim(0)


def rows_bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def as_struct(df: DataFrame, name: str = "__row") -> Column:
    """All columns of df as one struct, so that names of an operator's own columns can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def sql_text(value: str) -> str:
    """A SQL string literal that means value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes; null: 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

