from pyspark.sql import Window
from pyspark.sql import functions as F

from lectio.operators.joins import hot_split_join, lookup_join
from lectio.operators.sequence import with_row_number


def test_hot_split_join_equals_broadcast(spark):
    left = spark.range(0, 5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)).alias("k"),
                                       F.col("id"))
    right = spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(tuple(r) for r in lookup_join(left, right, "k", how).collect())
        b = sorted(tuple(r) for r in hot_split_join(left, right, "k", how, hot_keys=5, sample=1.0).collect())
        s = sorted(tuple(r) for r in hot_split_join(left, right, "k", how, hot_keys=5, sample=0.05).collect())
        assert s == a
        c = sorted(tuple(r) for r in lookup_join(left, right, "k", how, max_rows=10, hot_keys=5).collect())
        assert a == b == c


def test_row_number_matches_window(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3001).alias("x")).repartition(9)
    a = sorted(tuple(r) for r in with_row_number(df, ["x"], "rn").collect())
    b = sorted(tuple(r) for r in df.withColumn("rn", F.row_number().over(Window.orderBy("x"))).collect())
    assert a == b


def test_hot_split_with_a_third_on_one_key(spark):
    """A third of the probe rows share one key; results stay exact."""
    left = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 500).cast("string")))
        .alias("word"), F.col("id"))
    right = spark.range(0, 400).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"),
                                       F.col("id").alias("v")).union(spark.createDataFrame([("the", -1)], "word string, v long"))
    a = sorted(tuple(r) for r in left.join(right, "word", "left").collect())
    b = sorted(tuple(r) for r in hot_split_join(left, right, "word", "left", hot_keys=3, sample=0.05).collect())
    assert a == b
