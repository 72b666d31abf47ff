import pytest
from pyspark.sql import types as T

#: Texts with nulls, blanks, ties, repeated rows, markers and a very long one.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat of the house"),
    (2, None), (3, ""), (4, "   \n\t "), (5, "one two"), (6, "ONE two"),
    (7, "the QUICK brown fox jumps over the lazy dog and the cat of the house"),
    (7, "the QUICK brown fox jumps over the lazy dog and the cat of the house"),
    (8, "naïve ½ 中文 😀 <|endoftext|> \\0 </turn>\x1c x y"),
    (9, " ".join(f"w{i % 997} and" for i in range(60_000))),
    (None, "a row without an id but with the words that others have too"),
    (None, None),
    (10, "a row without an id but with the words that others have too"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with extra columns whose names operators use inside."""
    extra = ("id", "t", "h", "n", "m", "z", "ids", "c0", "leaf_tokens", "decoded", "kept", "score", "gone_id", "keep")
    rows = [(*r, *[f"{c}{i}" for c in extra]) for i, r in enumerate(TEXTS)]
    schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """Small tables need few tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
