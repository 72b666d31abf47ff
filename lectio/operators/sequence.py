"""Distributed sequential row numbers (P7, O1 positions, vocabulary ranks).

``row_number()`` over a window without ``partitionBy`` moves every row into
one task.  Instead the table is range-partitioned and sorted by the order key
(``orderBy``: many balanced partitions, sampled bounds); each row takes its
partition index and in-partition offset from ``monotonically_increasing_id``,
and those are *stored* with the rows as one Parquet table under the
checkpoint folder.  Partition sizes and the final positions are then both
derived from that stored table, so they cannot disagree: re-running the
sort in two branches could coalesce or split partitions differently (AQE
sizes shuffles by bytes, and a pruned branch has other bytes).  A table
with one row per partition (a few thousand rows at most) turns the sizes
into global offsets through a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def with_row_number(df: DataFrame, order: list | None, name: str = "row_id", start: int = 1) -> DataFrame:
    """Add ``name`` = 1-based position of the row in ``order`` (a total
    order); ``order=None`` numbers rows in their current physical order
    (file order, like ``zipWithIndex``).  Runs one job that writes the
    staged rows."""
    from lectio.session import scratch_path

    spark = df.sparkSession
    mid = F.monotonically_increasing_id()
    ordered = df if order is None else df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])
    staged = (ordered
              .withColumn("_part", F.shiftright(mid, 33))
              .withColumn("_local", mid.bitwiseAND(F.lit(_LOW_BITS))))
    path = scratch_path(spark, "row-number")
    staged.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (stored.join(F.broadcast(offsets), "_part", "inner")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + F.lit(start))
            .drop("_part", "_local", "_off"))
