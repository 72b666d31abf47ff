"""Sinks (K1-K5): CSV with or without BOM, Parquet with list columns,
fixed-header submissions, and audit outputs of intermediate rows.

Writers are distributed: each task writes its own part file; nothing is
collected to the driver.  Text cells may hold newlines, so CSV is always
written quoted and read back with ``multiLine``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"

CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "quoteAll": "false",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
    "lineSep": "\n",
}


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", bom: bool = False) -> str:
    """K1 (and K2 with ``bom=True``): header, no index column.

    The BOM is carried by the first header name, so every part file starts
    with it, which is what a BOM-aware reader expects of a CSV file.
    """
    out = df
    if bom and df.columns:
        first = df.columns[0]
        out = df.withColumnRenamed(first, BOM + first)
    out.write.mode(mode).options(**CSV_WRITE_OPTIONS).option("sep", sep).csv(path)
    return path


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    return write_csv(df, path, sep="\t", mode=mode)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    """K3: columnar sink; ``array<int>``/``array<double>`` columns stay typed."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def submission_frame(df: DataFrame, id_col: str, pred_col: str, header: tuple) -> DataFrame:
    """K4: the two columns under the fixed header pair, in id order (O3)."""
    id_name, pred_name = header
    return (df.select(F.col(id_col).alias(id_name), F.col(pred_col).cast("int").alias(pred_name))
            .orderBy(id_name))


def write_submission(df: DataFrame, path: str, id_col: str, pred_col: str,
                     header: tuple = ("Sentence ID", "Prediction")) -> str:
    """K4 sink: id-sorted part files, in order of their names."""
    return write_csv(submission_frame(df, id_col, pred_col, header), path)


def write_audit(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """K5: persist intermediate rows (exploded sentences, processed text)
    next to the main output for review."""
    if fmt == "csv":
        return write_csv(df, path)
    return write_parquet(df, path)
