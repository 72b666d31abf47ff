"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.session import scratch_path

#: Arrow batches leave a task once they hold about this many bytes.
BATCH_BYTES = 4 << 20
#: White space that separates words in the shingle and span operators.
WORD_SPACE = r"[\x20\x09-\x0D]+"


#: What empties the tables that an operator keeps in a worker process.
_KEPT: list[Callable[[], None]] = []


def keep(drop: Callable[[], None]) -> None:
    """Register what drops an operator's tables when others need the room."""
    _KEPT.append(drop)


def make_room() -> None:
    """Drop what tasks of other operators have kept in this worker process,
    which Spark uses again: a step then has its executor's memory to itself."""
    if TaskContext.get() is not None:
        for drop in _KEPT:
            drop()


def free_memory() -> None:
    """Give back what Arrow and the C library hold of freed memory: a worker
    process without a task would keep it from the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    lineage is cut, and a lost executor re-reads files.

    Spark removes a finished step's shuffle files when the driver collects
    its garbage, so that is asked for here; steps then don't add up on disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does the same to a text
    without other letters, at a fraction of ``translate``'s cost."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, upper, upper.lower()))


def batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Collect row tuples into Arrow batches of bounded bytes.  ``weight`` is
    the position of the column whose length is the bulk of a row."""
    buf: list[tuple] = []
    size = 0
    for row in rows:
        buf.append(row)
        size += 64 + (len(row[weight]) if weight is not None and row[weight] is not None else 0)
        if size >= BATCH_BYTES:
            yield _batch(buf, schema)
            buf, size = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(buf: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*buf), schema)], schema=schema)
