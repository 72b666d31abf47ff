"""Sentence -> document roll-ups and prediction post-processing.

A document's level is its hardest sentence.  ``MAX`` is decomposable, so the
``groupBy`` pre-aggregates on the map side and shuffles one row per
(document, partition); a document — or a source holding a third of all
documents — never lands whole in one task before that reduction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions.levels import clip_level, score_to_level


def linear_score(sums: DataFrame, id_cols=("doc_id", "pos")) -> DataFrame:
    """The fixed linear scorer over A4's sums, written with integer sums and
    one division (so every engine computes the same double):

    raw = (4·sum_len + 8·sum_diff + 24·n_hard + n_words² − 32·n_words) / (4·n_words)

    A sentence without words scores 0.0.
    """
    n = F.col("n_words")
    num = (F.lit(4) * F.col("sum_len") + F.lit(8.0) * F.col("sum_diff")
           + F.lit(24) * F.col("n_hard") + n * n - F.lit(32) * n)
    raw = F.when(n > 0, num.cast("double") / (F.lit(4) * n).cast("double")).otherwise(F.lit(0.0))
    return sums.select(*id_cols, raw.alias("raw"))


def doc_level_from_raw(scored: DataFrame, doc_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """A1: MAX of raw sentence scores per document, then F17."""
    return (scored.groupBy(doc_col).agg(F.max(raw_col).alias("raw_max"))
            .select(doc_col, score_to_level("raw_max").alias("level")))


def doc_level_from_levels(levels: DataFrame, doc_col: str = "doc_id", level_col: str = "level") -> DataFrame:
    """A2: MAX of already discrete sentence levels (equals A1 since F17 is
    monotone)."""
    return levels.groupBy(doc_col).agg(F.max(level_col).cast("int").alias("level"))


def fill_levels(ids: DataFrame, levels: DataFrame, doc_col: str = "doc_id",
                level_col: str = "level", default: int = 1) -> DataFrame:
    """Every document id with its level; missing -> ``default``."""
    return (ids.select(doc_col).join(levels.select(doc_col, level_col), doc_col, "left")
            .select(doc_col, F.coalesce(F.col(level_col), F.lit(default)).cast("int").alias(level_col)))


def ensemble_levels(preds: DataFrame, id_col: str = "doc_id", pred_col: str = "prediction") -> DataFrame:
    """Mean prediction over models per row, half-to-even, clip 1..19."""
    mean = F.sum(F.col(pred_col).cast("double")) / F.count(pred_col).cast("double")
    return preds.groupBy(id_col).agg(clip_level(mean).alias("level"))
