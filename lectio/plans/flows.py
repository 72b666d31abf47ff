"""End-to-end plans built from the operators.

* :func:`prepare_corpus`   — §3.1: sources -> unified, cleaned, shuffled table.
* :func:`train_sentence_model` — §3.2: corpus -> morphological text -> model.
* :func:`document_levels`  — M11: documents -> sentences -> segmented text ->
  model scores -> MAX per document -> every id filled -> submission frame.

Each returns a lazy DataFrame (model fits excepted); one job runs at the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.operators import models as MD
from lectio.operators.morph import morph_text
from lectio.operators.rollup import doc_level_from_raw, fill_levels
from lectio.operators.segment import sentences
from lectio.sources.sinks import submission_frame


def train_sentence_model(labelled: DataFrame, analyses: DataFrame, id_cols=("doc_id", "pos"),
                         text_col: str = "sentence", label_col: str = "label", seg: DataFrame | None = None, **fit_kw):
    """§3.2: segmented (d3tok) text of labelled sentences -> regression.
    ``seg``: that text, where it is stored."""
    if seg is None:
        seg = morph_text(labelled, analyses, id_cols, text_col, keep=(label_col,))
    return MD.fit_regressor(seg, "d3tok_text", label_col, **fit_kw)


def document_levels(docs: DataFrame, analyses: DataFrame, model, ids: DataFrame | None = None,
                    header: tuple = ("Document ID", "Prediction"), seg: DataFrame | None = None) -> DataFrame:
    """F2 -> M10 -> M8 -> A1 -> J1 -> K4.  ``seg``: the segmented text of
    all sentences of ``docs``, where it is stored."""
    if seg is None:
        seg = morph_text(sentences(docs.select("doc_id", "text"), "clean"), analyses)
    scored = MD.regression_levels(model, seg, ["doc_id", "pos"])
    levels = doc_level_from_raw(scored)
    filled = fill_levels((ids if ids is not None else docs).select("doc_id"), levels)
    return submission_frame(filled, "doc_id", "level", header)


def segmented(labelled: DataFrame, analyses: DataFrame, id_cols=("doc_id", "pos"), keep: tuple = ("label",)) -> DataFrame:
    """Labelled sentences with their segmented text (``d3tok_text``)."""
    return morph_text(labelled, analyses, id_cols, keep=keep)


def document_class_levels(docs: DataFrame, analyses: DataFrame, model, ids: DataFrame | None = None,
                          header: tuple = ("Document ID", "Prediction"), seg: DataFrame | None = None) -> DataFrame:
    """M11 with a word classifier: F2 -> M10 -> M6 -> A2 -> J1 -> K4.  ``seg``
    as in :func:`document_levels`."""
    from lectio.operators.bayes import bayes_levels
    from lectio.operators.rollup import doc_level_from_levels

    if seg is None:
        seg = morph_text(sentences(docs.select("doc_id", "text"), "clean"), analyses)
    levels = bayes_levels(model, seg, "d3tok_text", ["doc_id", "pos"])
    filled = fill_levels((ids if ids is not None else docs).select("doc_id"), doc_level_from_levels(levels))
    return submission_frame(filled, "doc_id", "level", header)


def sentence_levels_python(sums: DataFrame, id_cols=("doc_id", "pos")) -> DataFrame:
    """V2: score A4's sums with a user NumPy model in Arrow batches of 128."""
    import pandas as pd

    predict = MD.linear_sums_model()

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = predict(pdf["n_words"].to_numpy(), pdf["sum_len"].to_numpy(),
                      pdf["sum_diff"].to_numpy(), pdf["n_hard"].to_numpy())
        out = pdf[list(id_cols)].copy()
        out["level"] = MD.levels_numpy(raw)
        return out

    schema = ", ".join([f"{c} {sums.schema[c].dataType.simpleString()}" for c in id_cols] + ["level int"])
    cols = [*id_cols, "n_words", "sum_len", "sum_diff", "n_hard"]
    return MD.map_batches(sums.select(*cols), fn, schema)


def sentence_levels_udf(sums: DataFrame, id_cols=("doc_id", "pos")) -> DataFrame:
    """M8: the same user model through ``predict_batch_udf``."""
    from lectio.functions.levels import score_to_level

    udf = MD.predict_batches(MD.linear_sums_model, ["n_words", "sum_len", "sum_diff", "n_hard"])
    raw = udf(F.col("n_words").cast("double"), F.col("sum_len").cast("double"),
              F.col("sum_diff").cast("double"), F.col("n_hard").cast("double"))
    return sums.select(*id_cols, score_to_level(raw).alias("level"))


def hybrid_document_levels(docs: DataFrame, lexicon: DataFrame, model, ids: DataFrame | None = None,
                           header: tuple = ("Document ID", "Prediction")) -> DataFrame:
    """Document scoring with a hybrid sentence classifier: F1 (blank lines
    kept, scored on seven zero features) -> A4 -> M7 head -> O4/P9 ->
    A2 (MAX of levels) -> J1 -> K4."""
    from lectio.operators.features import LEXICAL_NAMES, lexical_features
    from lectio.operators.rollup import doc_level_from_levels

    sent = sentences(docs.select("doc_id", "text"), "raw")
    feats = lexical_features(sent, lexicon, keep=("sentence",), fold_case=True)
    levels = MD.class_levels(model, feats.select("doc_id", "pos", "sentence", *LEXICAL_NAMES), ["doc_id"])
    filled = fill_levels((ids if ids is not None else docs).select("doc_id"), doc_level_from_levels(levels))
    return submission_frame(filled, "doc_id", "level", header)
