"""Shared parts of the training-data operators: reading, text keys and column names."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.graph import components, shared_dir, stash, unstash  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a batch that is sent to Python: Spark's 10,000 whole texts are many MB, and a JVM and its workers hold several batches at a time.
BATCH, _BATCH = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the batch size of the session, unless it is lower. Results don't depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH:
        spark.conf.set(_BATCH, BATCH)


def held() -> dict:
    """What a worker's tasks keep for each other. It goes when the worker takes up a function that doesn't keep it."""
    return sys.modules.setdefault("_auditlake_worker", types.ModuleType("_auditlake_worker")).__dict__


def give_back(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A function of batches that returns freed memory to the system at its end: workers stay between tasks, and would keep the most that one took.

    Unless keep, it begins by dropping what other functions' tasks have left in held().
    """

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    def both(batches: Iterator) -> Iterator:
        if not keep and sys.modules.pop("_auditlake_worker", None):
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return both


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows. As an Arrow table it needs no Python on executors, where a list takes workers of its own."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))
