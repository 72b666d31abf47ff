"""Scoring models.

The reference fine-tunes GPU transformers; those are not rebuilt.  The
Spark counterparts are ``pyspark.ml`` pipelines trained and applied in a
distributed way (hashing TF-IDF, linear/logistic regression, MLP), and a
batch hook for any user Python model: Arrow batches through
``predict_batch_udf`` or ``mapInPandas`` (128 rows per call, as the
reference batches inference), loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import LinearRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions.levels import N_LEVELS, from_model_label, score_to_level, to_model_label
from lectio.functions.text import NOT_WS, UNICODE

BATCH_ROWS = 128


def _fit(pipeline: Pipeline, data: DataFrame) -> PipelineModel:
    """Fit with the training frame persisted (memory, spilling to disk):
    IDF/scaler and the optimiser each pass over it; a lost block is
    recomputed from lineage."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(data)
    finally:
        data.unpersist()


def fit_feature_regressor(train: DataFrame, names: list[str], label_col: str = "label") -> PipelineModel:
    """M5 on feature columns: least squares in closed form (normal
    equations, one pass); the target is the 0-based level."""
    data = train.withColumn("_target", to_model_label(label_col).cast("double"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="_features"),
        LinearRegression(featuresCol="_features", labelCol="_target", predictionCol="_raw", solver="normal"),
    ]).fit(data)


def _text_stages(text_col: str, num_features: int, min_docs: int = 0):
    """``min_docs``: tokens of fewer training texts weigh nothing."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=UNICODE + NOT_WS + "+", gaps=False,
                       toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_docs),
    ]


def fit_regressor(train: DataFrame, text_col: str = "text", label_col: str = "label",
                  num_features: int = 1 << 16, reg: float = 0.1, max_iter: int = 50) -> PipelineModel:
    """M5: ordinal regression on text; the target is the 0-based level."""
    data = train.withColumn("_target", to_model_label(label_col).cast("double"))
    lr = LinearRegression(featuresCol="_tfidf", labelCol="_target", predictionCol="_raw",
                          regParam=reg, elasticNetParam=0.0, maxIter=max_iter)
    return _fit(Pipeline(stages=_text_stages(text_col, num_features) + [lr]), data)


def fit_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                   num_features: int = 1 << 16, reg: float = 0.01, max_iter: int = 50) -> PipelineModel:
    """M6: 19-class classification (arg-max of class scores)."""
    data = train.withColumn("_target", to_model_label(label_col).cast("double"))
    lr = LogisticRegression(featuresCol="_tfidf", labelCol="_target", predictionCol="_class",
                            family="multinomial", regParam=reg, maxIter=max_iter)
    return _fit(Pipeline(stages=_text_stages(text_col, num_features) + [lr]), data)


def regression_levels(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """M8 + F17: score rows, keep ``raw`` and the 1..19 ``level``."""
    out = model.transform(df)
    return out.select(*keep, F.col("_raw").alias("raw"), score_to_level("_raw").alias("level"))


def class_levels(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """M8 + P9: predicted class + 1."""
    out = model.transform(df)
    return out.select(*keep, from_model_label(F.col("_class").cast("int")).alias("level"))


def with_vector(df: DataFrame, array_col: str, out: str = "_vec") -> DataFrame:
    """``array<float>`` -> ML vector, JVM-side."""
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def fit_hybrid(train: DataFrame, vector_col: str, feature_cols: list[str], label_col: str = "label",
               head: str = "linear", n_classes: int = N_LEVELS, hidden=(32,), seed: int = 42) -> PipelineModel:
    """M7: dense text vector ⧺ lexical features -> scaler -> head.

    ``head='linear'`` regresses the level; ``head='mlp'`` classifies with a
    small multilayer perceptron (classes 0..n_classes-1)."""
    data = with_vector(train, vector_col).withColumn("_target", F.col(label_col).cast("double"))
    assemble = VectorAssembler(inputCols=["_vec"] + list(feature_cols), outputCol="_x")
    scale = StandardScaler(inputCol="_x", outputCol="_xs", withMean=True, withStd=True)
    if head == "linear":
        est = LinearRegression(featuresCol="_xs", labelCol="_target", predictionCol="_raw", regParam=0.01)
    else:
        width = len(train.first()[vector_col]) + len(feature_cols)
        est = MultilayerPerceptronClassifier(featuresCol="_xs", labelCol="_target", predictionCol="_class",
                                             layers=[width, *hidden, n_classes], seed=seed, maxIter=100)
    return _fit(Pipeline(stages=[assemble, scale, est]), data)


def fit_text_hybrid(train: DataFrame, text_col: str, feature_cols: list[str], label_col: str = "label",
                    num_features: int = 1 << 14, reg: float = 0.01, max_iter: int = 30) -> PipelineModel:
    """M7 at sentence level: TF-IDF text vector ⧺ standardised lexical
    features -> 19-class multinomial head (arg-max = O4, +1 = P9)."""
    data = train.withColumn("_target", to_model_label(label_col).cast("double"))
    feats = VectorAssembler(inputCols=list(feature_cols), outputCol="_f")
    scale = StandardScaler(inputCol="_f", outputCol="_fs", withMean=True, withStd=True)
    both = VectorAssembler(inputCols=["_tfidf", "_fs"], outputCol="_x")
    head = LogisticRegression(featuresCol="_x", labelCol="_target", predictionCol="_class",
                              family="multinomial", regParam=reg, maxIter=max_iter)
    return _fit(Pipeline(stages=_text_stages(text_col, num_features) + [feats, scale, both, head]), data)


def hybrid_predict(model: PipelineModel, df: DataFrame, vector_col: str, keep: list[str]) -> DataFrame:
    out = model.transform(with_vector(df, vector_col))
    pred = F.col("_raw") if "_raw" in out.columns else F.col("_class")
    return out.select(*keep, pred.alias("prediction"))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
                batch_rows: int = BATCH_ROWS) -> DataFrame:
    """V2: apply ``fn`` to Arrow batches of at most ``batch_rows`` rows.

    Runs in every partition's Python worker (no shuffle, no driver
    round-trip); the incoming Arrow batch is re-chunked so ``fn`` sees the
    batch size it was written for without touching session settings."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                yield fn(pdf.iloc[start:start + batch_rows].reset_index(drop=True))
    return df.mapInPandas(run, schema)


def predict_batches(make_predict_fn: Callable, input_cols: list[str], return_type=T.DoubleType(),
                    batch_size: int = BATCH_ROWS):
    """M8 for an arbitrary Python model: a ``predict_batch_udf`` column
    function; ``make_predict_fn`` runs once per Python worker."""
    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                             input_tensor_shapes=[[] for _ in input_cols])


# A user model used by the batch-scoring queries: the fixed linear scorer
# over A4's integer sums, written in NumPy (same arithmetic as SQL).
def linear_sums_model():
    def predict(n_words: np.ndarray, sum_len: np.ndarray, sum_diff: np.ndarray, n_hard: np.ndarray) -> np.ndarray:
        n = n_words.astype(np.float64)
        num = (4.0 * sum_len.astype(np.float64) + 8.0 * sum_diff.astype(np.float64)
               + 24.0 * n_hard.astype(np.float64) + n * n - 32.0 * n)
        den = 4.0 * n
        out = np.zeros_like(num)
        np.divide(num, den, out=out, where=den > 0)
        return out
    return predict


def levels_numpy(raw: np.ndarray, n_levels: int = N_LEVELS) -> np.ndarray:
    """F17 in NumPy (``np.round`` is half-to-even)."""
    return (np.clip(np.round(raw), 0, n_levels - 1) + 1).astype(np.int32)
