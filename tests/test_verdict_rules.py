"""Rules for missing values, repeated keys and plans that gather nothing."""

import pytest
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators import features as feat
from lectio.operators import metrics as M
from lectio.operators import split as SP
from lectio.operators.encode import encode_fixed
from lectio.operators.joins import measured, sized_broadcast


def test_every_metric_refuses_missing_predictions(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (None, 3), (4, 4)], "gold long, pred long")
    for metric in (lambda: M.qwk(df), lambda: M.qwk(df, labels="fixed"), lambda: M.accuracy(df).collect(),
                   lambda: M.score_set(df, M.equal_width_bands(spark))):
        with pytest.raises(Exception, match="2 pairs lack a label or a prediction"):
            metric()


def test_undefined_kappa_is_nan(spark):
    df = spark.createDataFrame([(3, 3.0), (3, 3.0)], "label int, prediction double")
    with pytest.warns(UserWarning, match="undefined"):
        value = M.QWKEvaluator().evaluate(df)
    assert value != value


def test_every_sentence_is_encoded(spark):
    sent = spark.createDataFrame([(1, 0, "a b a"), (1, 1, ""), (1, 2, "   "), (1, 3, "zz")], "doc_id long, pos int, sentence string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, id int")
    rows = {r.pos: r for r in encode_fixed(sent, vocab, max_len=4).collect()}
    assert rows[0].input_ids == [1, 2, 1, 0] and rows[0].n_tokens == 3
    for pos in (1, 2, 3):
        assert rows[pos].input_ids == [0] * 4 == rows[pos].attention_mask
    assert [rows[p].n_tokens for p in (1, 2, 3)] == [0, 0, 1]


def test_quota_is_exact_with_repeated_ids_and_null_labels(spark):
    rows = [(i % 10, "a") for i in range(100)] + [(1000 + i, None) for i in range(7)]
    out = SP.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label", 0.15).collect()
    assert len(out) == 107
    assert sum(r.split == "dev" for r in out) == 15
    assert all((r.split is None) == (r.label is None) for r in out)


def test_lookup_as_written_and_one_row_per_lemma(spark):
    sent = spark.createDataFrame([(1, 0, "Paris paris x")], "doc_id long, pos int, sentence string")
    lex = spark.createDataFrame([("Paris", 2.0, 1), ("Paris", 5.0, 2), ("x", 1.0, 3)], "lemma string, score double, row int")
    r = feat.lexical_features(sent, lex, order_col="row").first()
    assert (r.f_words, r.f_max_diff, r.f_mean_diff) == (3.0, 5.0, 3.0) and r.f_oov_share == pytest.approx(1 / 3)
    folded = feat.lexical_features(sent, lex, fold_case=True, order_col="row").first()
    assert folded.f_oov_share == 0.0 and folded.f_mean_diff == pytest.approx(11 / 3)


def test_token_rows_hold_no_text(spark):
    sent = spark.createDataFrame([(1, 0, "a b")], "doc_id long, pos int, sentence string")
    lex = spark.createDataFrame([("a", 2.0)], "lemma string, score double")
    plan = feat.lexical_sums(sent, lex, keep=("sentence",))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Aggregate [doc_id" in line:
            assert "sentence" not in line.split("]")[0]


def test_size_check_gathers_no_rows(spark):
    df = spark.range(1000).select(F.col("id"), F.lit("abcd").alias("s"), F.array(F.lit(1), F.lit(2)).alias("a"))
    assert measured(df) == (1000, 1000 * (16 + 20 + 48))
    assert measured(df.limit(0)) == (0, 0)
    assert sized_broadcast(df, max_rows=999) is None and sized_broadcast(df, max_bytes=100) is None
    assert sized_broadcast(df) is not None


def test_empty_lemma_is_absent(spark):
    df = spark.createDataFrame([("", "noun"), ("a", ""), (None, "noun"), ("a", "noun")], "l string, p string")
    assert [r[0] for r in df.select(T.lemma_pos_key("l", "p")).collect()] == [None, None, None, "a#noun"]
