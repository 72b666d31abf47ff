"""Multinomial naive Bayes over words (M6).

The model is two tables: the classes with their priors, and for every word of
the vocabulary its weight in each class.  Both come from integer counts of
(class, word); weights are logarithms in fixed point, so every sum is one of
integers and does not depend on its order.  No model is held by the driver.

Scoring joins the words of a text to the second table, adds up the weights by
class before anything is shuffled, and takes the class with the highest sum
(the smallest one on ties).  Words beyond the vocabulary are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators.features import ROW_KEYS, count_rows, explode_tokens, keyed, per_row, repeated
from lectio.operators.joins import hot_sample, lookup_join
from lectio.session import cut_lineage, stored_rows

#: Fixed point of the logarithms.
SCALE = 1_000_000


@dataclass
class BayesModel:
    """``classes``: label, prior; ``words``: word, weights (one for each class
    in the order of ``labels``)."""
    classes: DataFrame
    words: DataFrame
    labels: list[int]


def fixed_log(numerator: Column, denominator: Column) -> Column:
    """ln(numerator / denominator) in fixed point."""
    ratio = numerator.cast("double") / denominator.cast("double")
    return F.floor(F.log(ratio) * F.lit(float(SCALE)) + F.lit(0.5)).cast("long")


def word_rows(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(T.whitespace_tokens(F.lower(F.col(text_col)))).alias("word"))


def fit_bayes(train: DataFrame, text_col: str = "text", label_col: str = "label", smoothing: int = 1,
              min_count: int = 1) -> BayesModel:
    """M6: priors from the rows, weights from the words with Laplace
    smoothing; the vocabulary is the words with ``min_count`` occurrences.
    Rows without a label are left out; a null text has no words."""
    rows = train.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")).filter("label IS NOT NULL")
    counts = word_rows(rows, "text", ["label"]).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = stored_rows(counts, "word-counts")
    if min_count > 1:
        common = counts.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_count).select("word")
        counts = stored_rows(counts.join(common, "word"), "word-counts")
    total = F.sum("rows").over(Window.partitionBy())  # over the classes: a few rows
    seen = counts.groupBy("label").agg(F.sum("n").alias("tokens"))
    size = counts.select("word").distinct().agg(F.count(F.lit(1)).alias("size"))
    classes = (rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(seen, "label", "left")
               .crossJoin(F.broadcast(size)))  # one row of one number
    classes = cut_lineage(classes.select(
        "label", fixed_log(F.col("rows"), total).alias("prior"),
        (F.coalesce("tokens", F.lit(0)) + F.lit(smoothing) * F.col("size")).alias("mass")))
    found = classes.orderBy("label").collect()  # one row per class
    labels = [r["label"] for r in found]
    per_class = [F.coalesce(F.max(F.when(F.col("label") == r["label"], F.col("n"))), F.lit(0)) for r in found]
    weights = F.array(*[fixed_log(n + F.lit(smoothing), F.lit(r["mass"])) for n, r in zip(per_class, found)])
    words = counts.groupBy("word").agg(weights.alias("weights")) if found else counts.select(
        "word", F.array().cast("array<bigint>").alias("weights"))
    return BayesModel(classes.select("label", "prior"), stored_rows(words, "word-weights"), labels)


def bayes_scores(model: BayesModel, df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``scores``: the fixed-point score of every class."""
    priors = {r["label"]: r["prior"] for r in model.classes.collect()}  # one row per class
    rows = keyed(df.select(*keep, F.col(text_col).alias("_text")), "_text")
    tokens = explode_tokens(rows, keep, "_text", tokenizer=lambda t: T.whitespace_tokens(F.lower(t)), keep=ROW_KEYS)
    probe = word_rows(hot_sample(df), text_col, [])
    joined = lookup_join(tokens.withColumnRenamed("token", "word"), model.words, "word", "left", probe=probe)
    sums = joined.groupBy(*keep, *ROW_KEYS).agg(
        count_rows(), *[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0)).alias(f"_s{i}") for i in range(len(model.labels))])
    scores = [per_row(F.col(f"_s{i}")) + F.lit(priors[v]) for i, v in enumerate(model.labels)]
    return repeated(sums.withColumn("scores", F.array(*scores))).select(*keep, "scores")


def bayes_levels(model: BayesModel, df: DataFrame, text_col: str, keep: list[str], out: str = "level") -> DataFrame:
    """M8 + O4: the class with the highest score for every row, also those
    without known words."""
    if not model.labels:
        raise ValueError("the model has no classes")
    scores = bayes_scores(model, df, text_col, keep)
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scores.select(*keep, F.element_at(F.array(*[F.lit(v) for v in model.labels]), best).alias(out))


FORMAT_VERSION = 1


def save_bayes(model: BayesModel, path: str) -> str:
    """The model as Parquet tables below ``path``: the format's version, the
    classes and the words."""
    spark = model.classes.sparkSession
    version = spark.createDataFrame([(FORMAT_VERSION, SCALE)], "version int, scale long")
    for name, table in (("classes", model.classes), ("words", model.words), ("version", version)):
        table.write.parquet(f"{path}/{name}")  # the version last: a model with one is complete
    return path


def load_bayes(spark: SparkSession, path: str) -> BayesModel:
    version = spark.read.parquet(f"{path}/version").first()
    if (version["version"], version["scale"]) != (FORMAT_VERSION, SCALE):
        raise ValueError(f"{path}: a model of format {version['version']}, this library reads {FORMAT_VERSION}")
    classes = spark.read.parquet(f"{path}/classes")
    labels = [r["label"] for r in classes.orderBy("label").collect()]  # one row per class
    return BayesModel(classes, spark.read.parquet(f"{path}/words"), labels)
