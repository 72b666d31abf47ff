"""Storage layout: documents bucketed by their key.

Every per-sentence and per-document aggregation in this engine is keyed by
the document id, and `Generate` (explode) and broadcast joins keep the input's
hash partitioning.  When the documents table is bucketed by ``doc_id``, the
scan reports that partitioning, so the sentence sums, the MAX roll-up and a
join with another table bucketed the same way need no exchange at all: the
whole scoring plan becomes one stage of narrow work per bucket.  Writing the
layout costs one shuffle, once; every later query saves its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "doc_id", buckets: int = 64,
                   mode: str = "overwrite") -> str:
    """Write ``df`` as an external table bucketed and sorted by ``key``.

    ``path`` should be shared storage (e.g. below ``spark.checkpoint.dir`` or
    the warehouse); ``buckets`` is chosen so that one bucket of text is a few
    hundred MB."""
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return table


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The bucketed table; its scan carries ``HashPartitioning(key)``."""
    return spark.table(table)
