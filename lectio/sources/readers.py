"""Readers (S1-S9).

Schemas are declared, never inferred (no extra pass over the data), and
checked against the file's header.  Text cells may span lines, so CSV is
read with ``multiLine``; that makes each CSV file one split, which is fine
for corpora stored as many part files and is why large inputs should be
Parquet (S5), which splits by row group and prunes columns at the scan.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.session import path_exists

LOG = logging.getLogger("lectio.readers")
BOM = "﻿"
# Strings pandas reads as missing by default; Spark's CSV reader knows one
# ``nullValue``, so they are mapped explicitly when asked for.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

CSV_READ_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def clean_header(names: list[str]) -> list[str]:
    """Drop a leading BOM and surrounding white space from names."""
    return [n.lstrip(BOM).strip() for n in names]


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The file's header names (reads the first record only)."""
    first = (spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).option("header", "false")
             .csv(path).limit(1).collect())
    return [str(v) for v in first[0]] if first else []


def check_columns(found: list[str], required: list[str], source: str = "input") -> None:
    """Fail early, listing what the file does hold."""
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"{source}: missing columns {missing}; found {found}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             check_header: bool = True, na_tokens: tuple | None = None,
             bom: bool = True) -> DataFrame:
    """CSV or TSV with a declared schema.

    The header is checked against the schema (after BOM/space clean-up);
    the file's columns are then read positionally under the declared names.
    ``na_tokens`` maps pandas-style missing markers in string columns to
    null.
    """
    if check_header:
        found = clean_header(header_of(spark, path, sep)) if bom else header_of(spark, path, sep)
        check_columns(found, schema.fieldNames(), path)
        if found != schema.fieldNames():
            raise ValueError(f"{path}: column order {found} differs from schema {schema.fieldNames()}")
    df = (spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).option("enforceSchema", "true")
          .schema(schema).csv(path))
    if na_tokens:
        df = null_tokens(df, na_tokens)
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, **kw) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", **kw)


def null_tokens(df: DataFrame, tokens: tuple = NA_TOKENS) -> DataFrame:
    """Map missing-value markers to null in every string column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*tokens), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                  corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """S3: PERMISSIVE scan; returns ``(good_rows, bad_rows)``.

    Malformed records keep their raw text in ``corrupt_col`` and are split
    off instead of failing the job (``on_bad_lines='warn'``).  Both frames
    read every column, so each is a plain streaming scan — nothing is
    cached, whatever the input size.
    """
    full = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
    df = (spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", corrupt_col).schema(full).csv(path))
    good = df.filter(F.col(corrupt_col).isNull()).drop(corrupt_col)
    bad = df.filter(F.col(corrupt_col).isNotNull())
    return good, bad


class RejectedRows:
    """How many rows of a scan were malformed; known once a job has read it."""

    def __init__(self, path: str):
        self.path, self.seen = path, Observation()

    def warn(self) -> int:
        """``on_bad_lines='warn'``: the number, logged if there are any."""
        n = self.seen.get["rejected"]
        if n:
            LOG.warning("%s: %d malformed rows were left out", self.path, n)
        return n


def read_warning(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                 corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, RejectedRows]:
    """S3: the well-formed rows, and the number of the others as the same scan
    counts them.  Every column is parsed, also one that is not used later, so
    the number does not depend on the query."""
    full = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
    df = (spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", corrupt_col).schema(full).csv(path))
    rejected = RejectedRows(path)
    every = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in schema.fieldNames()]))
    counted = df.observe(rejected.seen, F.count(F.col(corrupt_col)).alias("rejected"), every.alias("_"))
    return counted.filter(F.col(corrupt_col).isNull()).drop(corrupt_col), rejected


def read_flagged(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                 corrupt_col: str = "_corrupt_record", flag_col: str = "rejected") -> DataFrame:
    """S3 in one pass: every row, with malformed fields null and a boolean
    ``rejected`` flag (the whole scan is read, so no cache is needed)."""
    full = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
    df = (spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", corrupt_col).schema(full).csv(path))
    return df.select(*schema.fieldNames(), F.col(corrupt_col).isNotNull().alias(flag_col))


def count_bad(bad: DataFrame, corrupt_col: str = "_corrupt_record") -> int:
    """Rows split off by :func:`read_tolerant`.  Spark rejects a scan that
    reads only the corrupt-record column, and a pruned CSV scan parses only
    the referenced fields, so the aggregate touches every data column (no
    cache of the input is needed)."""
    data = [F.col(c) for c in bad.columns if c != corrupt_col]
    row = bad.agg(F.count(F.col(corrupt_col)).alias("n"), F.max(F.xxhash64(*data)).alias("_")).first()
    return int(row["n"])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columnar scan; list columns come back as typed arrays."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType,
                  reader: Callable[[SparkSession, str, T.StructType], DataFrame] | None = None) -> DataFrame:
    """An optional source; a missing path gives an empty typed frame."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return (reader or read_parquet)(spark, path, schema)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                    fmt: str = "parquet") -> DataFrame:
    """Read a stage if it was written before, else compute, write and
    read it back (so later steps start from the stored table, with lineage
    cut, and a lost executor re-reads files instead of recomputing).

    The stage is written to a temporary sibling and renamed into place
    once complete, so an existing path always holds a whole stage: a job
    that died half-way, or a concurrent writer, never leaves a partial
    table behind that a later run would take as done."""
    if not path_exists(spark, path):
        tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
        compute().write.mode("overwrite").format(fmt).save(tmp)
        if not _rename(spark, tmp, path) and not path_exists(spark, path):
            raise RuntimeError(f"could not publish stage {path}")
    return spark.read.format(fmt).load(path)


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    jvm = spark.sparkContext._jvm
    s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = s.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(d):  # another writer published first: keep theirs
        fs.delete(s, True)
        return False
    fs.mkdirs(d.getParent())
    return bool(fs.rename(s, d))


def parse_list_column(df: DataFrame, col: str, element: str = "double") -> DataFrame:
    """A list literal stored as text -> typed array (null when
    unparsable)."""
    return df.withColumn(col, F.from_json(F.col(col), f"array<{element}>"))
