"""Texts are looked up once for a fit and its scores, and few of their words are shuffled."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectio.operators import joins as J
from lectio.operators.morph import first_analysis, morph_text
from lectio.plans.queries import QUERIES
from tests.conftest import SF_SMALL


def test_frequent_keys_are_those_above_a_count(spark):
    rows = [("a",)] * 9 + [("b",)] * 5 + [("c",)] * 5 + [("d",)] * 2 + [(None,)] * 50 + [(f"x{i}",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "word string")

    def found(most):
        return {r.word for r in J.frequent_keys(df, ["word"], most).collect()}

    assert found(0) == set() and found(1) == {"a"}
    assert found(2) == {"a"}  # b and c come equally often: both or none
    assert found(3) == {"a", "b", "c"} and found(20_003) == {"a", "b", "c", "d"}
    assert len(found(J.DEFAULT_HOT_KEYS)) == 20_004  # formerly 10,000 at most


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_a_probe_only_chooses_the_path(spark, how):
    left = spark.createDataFrame([(w, i) for i in range(30) for w in ("a", "b", "c", "d", None, "z")], "word string, n int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("q", 4)], "word string, v int")
    want = Counter(map(tuple, left.join(right, "word", how).collect()))
    for words in ((), ("a", "z"), ("a", "b", "c", "d", "q", "no")):
        probe = spark.createDataFrame([(w,) for w in words], "word string")
        got = J.hot_split_join(left, right, "word", how, probe=probe)
        assert Counter(map(tuple, got.collect())) == want, words


def test_segmented_sentences_are_not_gathered_by_token(spark):
    analyses = first_analysis(spark.createDataFrame(
        [("up", "u_+p", "up", "prt", 0.9), ("same", "same", "same", "noun", 0.9), ("cased", "cased", "cased", "noun", 0.9)],
        "word string, d3tok string, lex string, pos string, score double"))
    form = {"up": "u +p", "Up": "u +p", "Cased": "cased"}
    texts = ["up", "same word", "a up Up, Cased! up", "", None, "  ", " ".join(["up", "w", "Cased"] * 400), "same word", "same word"]
    rows = [(i if i < 7 else 7, 0, t, i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, 1, "x up", 5), (None, 1, "x up", 5)], "doc_id long, pos int, sentence string, mark int")
    out = morph_text(df, analyses, keep=("mark",))
    want = Counter((r.doc_id, r.pos, r.mark, " ".join(form.get(w, w) for w in (r.sentence or "").replace(",", " ,").replace("!", " !").split()))
                   for r in df.collect())
    assert Counter(map(tuple, out.collect())) == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["ordinal_level", "regression_closed_form", "cv_qwk", "cv_best", "fold_ensemble",
                                  "hybrid_ridge_level", "hybrid_level", "normalized_features"])
def test_texts_are_read_once(spark, name):
    """What a model is fitted on and applied to is stored, not derived again."""
    files = QUERIES[name](spark, SF_SMALL).inputFiles()
    assert files and not [f for f in files if f.endswith("documents.parquet")]


def test_segmented_once(spark, monkeypatch):
    from lectio.plans import flows

    calls = []
    monkeypatch.setattr(flows, "morph_text", lambda *a, **k: calls.append(1) or morph_text(*a, **k))
    for name in ("document_scoring", "document_regression"):
        calls.clear()
        assert QUERIES[name](spark, SF_SMALL).count() and calls == [1], name
