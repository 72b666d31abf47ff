"""Joins on keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on (one over it), so there are at
#: most as many hot keys, whatever the data.
HOT_SHARE = 256


def counted_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count_col: str = "n",
                 share: int = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and,
    in ``count_col``, how many of the ``total`` rows have that key.

    Keys with more than ``total / share`` rows are fewer than ``share``; their
    table rows are broadcast.  The other rows meet in a shuffle in which no key
    holds more than that part of them.  ``count_col`` is dropped.
    """
    hot = table.filter(F.col(count_col) * share > total).drop(count_col)
    cold = table.filter(F.col(count_col) * share <= total).drop(count_col)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold_rows.join(cold, keys))
