"""Ordinal evaluation.

The only pass over the (possibly huge) prediction table is one partial
aggregation to the confusion counts ``(gold, pred, n)`` — at most
``levels²`` rows.  Everything after works on that tiny table, so the metrics
cost one scan and a shuffle of a few hundred rows, whatever the data size.
Kappa is computed from exact integer moments (``decimal(38,0)``) and one
final division, so it does not depend on partitioning or merge order.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lectio.functions.levels import N_LEVELS
from lectio.session import cut_lineage

def confusion(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """``(gold, pred, n)``: one partial aggregation over the input, read once
    (it is checkpointed: the metrics use it several times).

    A pair with a missing label or prediction cannot be placed on the scale,
    and leaving it out would flatter the score, so it is an error that says
    how many there are; fill or drop them first."""
    conf = cut_lineage(
        df.select(F.col(gold_col).cast("long").alias("gold"), F.col(pred_col).cast("long").alias("pred"))
        .groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")))
    missing = conf.filter("gold IS NULL OR pred IS NULL").agg(F.sum("n")).first()[0]
    if missing:
        raise ValueError(f"{missing} pairs lack a label or a prediction")
    return conf


def _observed_ranks(conf: DataFrame) -> DataFrame:
    """Dense rank of every label seen in either column (the library's
    ``unique_labels`` positions)."""
    labels = conf.select(F.col("gold").alias("v")).union(conf.select(F.col("pred").alias("v"))).distinct()
    return labels.select("v", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("long").alias("r"))


def _ranked(conf: DataFrame, labels: str) -> DataFrame:
    """``(gold, pred, a, b, n)`` with ``a``/``b`` the weights' positions."""
    if labels == "fixed":
        return conf.select("gold", "pred", F.col("gold").alias("a"), F.col("pred").alias("b"), "n")
    if labels != "observed":
        raise ValueError("labels must be 'observed' or 'fixed'")
    ranks = _observed_ranks(conf)
    ga = ranks.select(F.col("v").alias("gold"), F.col("r").alias("a"))
    pb = ranks.select(F.col("v").alias("pred"), F.col("r").alias("b"))
    return conf.join(ga, "gold").join(pb, "pred").select("gold", "pred", "a", "b", "n")


def _dec(c):
    return c.cast("decimal(38,0)")


def _moment_aggs(a_col: str = "a", b_col: str = "b", n_col: str = "n"):
    a, b, n = _dec(F.col(a_col)), _dec(F.col(b_col)), _dec(F.col(n_col))
    return [F.sum(n).alias("n"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"),
            F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"), F.sum(n * a * b).alias("sab")]


def kappa_moments(conf: DataFrame, labels: str = "observed") -> DataFrame:
    """One row of exact integer moments n, Sa, Sb, Saa, Sbb, Sab."""
    return _ranked(conf, labels).agg(*_moment_aggs())


def _kappa_expr():
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    num = n * (saa + sbb - F.lit(2) * sab)
    den = n * (saa + sbb) - F.lit(2) * sa * sb
    return F.when(den != 0, F.lit(1.0) - num.cast("double") / den.cast("double"))


def kappa_from_moments(m: DataFrame) -> DataFrame:
    """κ = 1 − n(Saa+Sbb−2Sab) / (n(Saa+Sbb) − 2·Sa·Sb); null if undefined."""
    return m.select(_kappa_expr().alias("qwk"), F.col("n").cast("long").alias("n"))


def qwk(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred", labels: str = "observed") -> DataFrame:
    """Quadratic weighted kappa as a one-row DataFrame ``(qwk, n)``.

    ``labels='observed'``: weights on positions in the sorted set of labels
    seen in either column (the reference library's behaviour);
    ``labels='fixed'``: weights on the label values themselves.
    """
    return kappa_from_moments(kappa_moments(confusion(df, gold_col, pred_col), labels))


def grouped_qwk(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A9 on the fixed scale for every group of ``keys``: ``counts`` holds
    their (gold, pred, n)."""
    moments = counts.withColumns({"a": F.col("gold"), "b": F.col("pred")}).groupBy(*keys).agg(*_moment_aggs())
    return moments.select(*keys, _kappa_expr().alias("qwk"), F.col("n").cast("long").alias("n"))


def equal_width_bands(spark: SparkSession, widths=(7, 5, 3), n_levels: int = N_LEVELS) -> DataFrame:
    """A band table ``level -> band_k`` cutting 1..n into k equal widths."""
    lv = spark.range(1, n_levels + 1).select(F.col("id").alias("level"))
    return lv.select("level", *[((F.col("level") - 1) * k / n_levels).cast("long").alias(f"band_{k}")
                                for k in widths])


def score_set(df: DataFrame, bands: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
              labels: str = "observed") -> DataFrame:
    """A10: accuracy, accuracy ±1, mean absolute distance, QWK and accuracy
    on each coarser band scale; all ×100 except the distance."""
    conf = confusion(df, gold_col, pred_col)
    band_cols = [c for c in bands.columns if c.startswith("band_")]
    bg = F.broadcast(bands.select(F.col("level").alias("gold"), *[F.col(c).alias(f"g_{c}") for c in band_cols]))
    bp = F.broadcast(bands.select(F.col("level").alias("pred"), *[F.col(c).alias(f"p_{c}") for c in band_cols]))
    ranked = _ranked(conf, labels)
    cb = ranked.join(bg, "gold", "left").join(bp, "pred", "left")
    tot = F.sum("n")
    diff = F.abs(F.col("gold") - F.col("pred"))

    def pct(cond):
        return (F.lit(100) * F.sum(F.when(cond, F.col("n")).otherwise(0))).cast("double") / tot.cast("double")

    agg = cb.agg(
        pct(F.col("gold") == F.col("pred")).alias("acc"),
        pct(diff <= 1).alias("acc_pm1"),
        (F.sum(diff * F.col("n")).cast("double") / tot.cast("double")).alias("avg_abs_dist"),
        *[pct(F.col(f"g_{c}") == F.col(f"p_{c}")).alias(f"acc_{c.split('_')[1]}") for c in band_cols],
        *_moment_aggs("a", "b", "n"))
    metrics = ["acc", "acc_pm1", "avg_abs_dist"] + [f"acc_{c.split('_')[1]}" for c in band_cols]
    return agg.select(*metrics, (F.lit(100.0) * _kappa_expr()).alias("qwk"))


def accuracy(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """Share of exact matches; the same rule for missing values as the
    other metrics (see :func:`confusion`)."""
    missing = F.sum((F.col(gold_col).isNull() | F.col(pred_col).isNull()).cast("long"))
    guard = F.when(missing > 0, F.raise_error(F.concat(
        missing.cast("string"), F.lit(" pairs lack a label or a prediction"))).cast("double"))
    hits = F.sum(F.when(F.col(gold_col) == F.col(pred_col), 1).otherwise(0)).cast("double")
    return df.agg(F.coalesce(guard, hits / F.count(F.lit(1)).cast("double")).alias("accuracy"))


def stage_counts(stages: dict) -> DataFrame:
    """``(stage, n_rows)`` for several DataFrames, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
             for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(df: DataFrame, counts: dict) -> DataFrame:
    """A7 for stages that are made row by row: ``counts`` gives each stage's
    rows per input row; one scan sums them all."""
    sums = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"s{i}") for i, c in enumerate(counts.values())])
    pairs = [F.struct(F.lit(name).alias("stage"), F.col(f"s{i}").alias("n_rows")) for i, name in enumerate(counts)]
    return sums.select(F.inline(F.array(*pairs)))


class StageCounts:
    """A7 from the job that writes a stage: counts ride on the rows as they
    pass (:meth:`count`), so no scan is made for them.  They are known once the
    job has run.  A stage that is written without a shuffle after the counted
    rows is counted exactly; a task that runs again counts once."""

    def __init__(self):
        self.observations: list[tuple[Observation, list[str]]] = []

    def count(self, df: DataFrame, counts: dict) -> DataFrame:
        """``df``, counted: ``counts`` gives each stage's rows per row."""
        seen, names = Observation(), list(counts)
        self.observations.append((seen, names))
        return df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"c{i}")
                                  for i, c in enumerate(counts.values())])

    def values(self) -> dict[str, int]:
        """The counts of jobs that have run."""
        return {name: seen.get[f"c{i}"] for seen, names in self.observations for i, name in enumerate(names)}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.values().items()), "stage string, n_rows long")


try:  # V4: the kappa as a Spark ML evaluator (usable in CrossValidator)
    from pyspark.ml.evaluation import Evaluator
    from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol

    class QWKEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
        """Evaluator whose metric is QWK of ``F17(prediction)`` vs the label
        (labels 1..19 stored; ``shift`` adds to the rounded prediction)."""

        def __init__(self, labelCol: str = "label", predictionCol: str = "prediction",
                     labels: str = "observed", regression: bool = True):
            super().__init__()
            self._set(labelCol=labelCol, predictionCol=predictionCol)
            self.labels = labels
            self.regression = regression

        def _evaluate(self, dataset: DataFrame) -> float:
            """NaN (and a warning) where kappa is undefined."""
            from lectio.functions.levels import score_to_level
            p = F.col(self.getPredictionCol())
            pred = score_to_level(p - 1) if self.regression else p.cast("int")
            scored = dataset.select(F.col(self.getLabelCol()).alias("gold"), pred.alias("pred"))
            row = qwk(scored).first()
            if row is None or row["qwk"] is None:
                warnings.warn("kappa is undefined on these labels", stacklevel=2)
                return float("nan")
            return float(row["qwk"])

        def isLargerBetter(self) -> bool:
            return True
except ImportError:  # pragma: no cover
    QWKEvaluator = None
