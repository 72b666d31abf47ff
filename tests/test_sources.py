import pytest
from pyspark.sql import types as T

from lectio.session import scratch_path
from lectio.sources import readers as R
from lectio.sources import sinks as K

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def test_header_check_lists_found_columns(spark):
    df = spark.createDataFrame([(1, "a\nb")], "id long, Sentence string")
    path = K.write_csv(df, scratch_path(spark, "hdr"))
    with pytest.raises(ValueError, match="missing columns"):
        R.read_csv(spark, path, SCHEMA)


def test_bom_round_trip_and_multiline_cells(spark):
    df = spark.createDataFrame([(1, ' a\n"b", '), (2, "")], SCHEMA)
    path = K.write_csv(df, scratch_path(spark, "bom"), bom=True)
    with open(next(p for p in __import__("glob").glob(path.replace("file:", "") + "/part-*.csv")
                   if __import__("os").path.getsize(p) > 0), encoding="utf-8") as fh:
        assert fh.read(1) == R.BOM
    back = sorted(tuple(r) for r in R.read_csv(spark, path, SCHEMA).collect())
    # quotes, commas, newlines and edge spaces survive; an empty cell reads
    # back as missing, as a pandas CSV round trip does
    assert back == [(1, ' a\n"b", '), (2, None)]


def test_tolerant_scan_splits_bad_rows(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "7")], "id long, n string")
    path = K.write_csv(df, scratch_path(spark, "bad"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    good, bad = R.read_tolerant(spark, path, schema)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 5), (3, 7)]
    assert R.count_bad(bad) == 1


def test_na_tokens_and_optional_source(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "ok")], SCHEMA)
    assert [r.text for r in R.null_tokens(df).orderBy("id").collect()] == [None, "ok"]
    empty = R.read_optional(spark, scratch_path(spark, "nothing-here"), SCHEMA)
    assert empty.count() == 0 and empty.schema == SCHEMA


def test_load_or_compute_computes_once(spark):
    path = scratch_path(spark, "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert R.load_or_compute(spark, path, build).count() == 3
    assert R.load_or_compute(spark, path, build).count() == 3
    assert len(calls) == 1
