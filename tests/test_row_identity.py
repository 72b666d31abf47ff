"""Rows are the sentences, whatever their ids: null, repeated and equal rows
against a loop over the rows."""

from collections import Counter

import pytest

from lectio.operators import features as feat
from lectio.operators.encode import encode_fixed
from lectio.operators.morph import first_analysis, morph_text
from lectio.functions import text as T

LEXICON = {"c": 1.0, "d": 5.0, "e": 2.5}
ROWS = [(1, 0, "c d e"), (1, 0, "c d f"), (1, 0, "c d f"), (1, 0, "c d f"), (None, 0, "c c"), (None, 0, "x"), (None, None, "x"),
        (None, None, "x"), (2, 0, ""), (2, 0, ""), (3, 1, "d d d d"), (3, 1, None), (4, 0, "  ")]


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [(*r, f"k{i}") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, pos int, sentence string, mark string").repartition(3)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "lemma string, score double")


def loop_features(text):
    words = (text or "").split()
    d = [LEXICON.get(w, 3.0) for w in words]
    n = len(words)
    if not n:
        return (0.0,) * 7
    return (float(len(text)), float(n), sum(map(len, words)) / n, sum(d) / n, max(d), float(sum(x > 4 for x in d)),
            sum(w not in LEXICON for w in words) / n)


def test_lexical_features_by_row(spark, sentences, lexicon):
    want = Counter((i, p, *loop_features(t)) for i, p, t in ROWS)
    got = Counter(map(tuple, feat.lexical_features(sentences.drop("mark"), lexicon).collect()))
    assert got == want
    kept = feat.lexical_features(sentences, lexicon, keep=("sentence", "mark"))
    want = Counter((i, p, t, f"k{n}", *loop_features(t)) for n, (i, p, t) in enumerate(ROWS))
    assert kept.columns[:4] == ["doc_id", "pos", "sentence", "mark"]
    assert Counter(map(tuple, kept.collect())) == want


def test_morph_text_by_row(spark, sentences):
    analyses = first_analysis(spark.createDataFrame([("c", "c_+x", "c", "noun", 0.9)],
                                                    "word string, d3tok string, lex string, pos string, score double"))
    scores = spark.createDataFrame([("c#noun", 4.0)], "lemma_pos string, score double")
    got = morph_text(sentences, analyses, lemma_pos_lexicon=scores, keep=("mark",)).collect()

    def one(n, i, p, t):
        words = (t or "").split()
        hits = [4.0 for w in words if w == "c"]
        return (i, p, f"k{n}", " ".join("c +x" if w == "c" else w for w in words), 4.0 if hits else 0.0, 4.0 if hits else 0.0)

    assert Counter(map(tuple, got)) == Counter(one(n, *r) for n, r in enumerate(ROWS))
    plain = morph_text(sentences.drop("mark"), analyses)
    assert Counter(map(tuple, plain.collect())) == Counter((one(0, *r)[0], one(0, *r)[1], one(0, *r)[3]) for r in ROWS)


def test_lemma_scores_by_row(spark, sentences):
    analyses = first_analysis(spark.createDataFrame([("c", "c", "c", "noun", 0.9)],
                                                    "word string, d3tok string, lex string, pos string, score double"))
    scores = spark.createDataFrame([("c#noun", 4.0)], "lemma_pos string, score double")
    toks = feat.explode_tokens(feat.keyed(sentences), tokenizer=T.word_tokens, keep=feat.ROW_KEYS)
    got = feat.lemma_pos_scores(toks, analyses, scores).collect()
    want = Counter((i, p, *[4.0 if "c" in (t or "").split() else 0.0] * 2) for i, p, t in ROWS)
    assert Counter(map(tuple, got)) == want


def test_encoding_by_row(spark, sentences):
    vocab = spark.createDataFrame([("c", 1), ("d", 2), ("x", 3)], "word string, id int")
    got = encode_fixed(sentences, vocab, max_len=4).collect()
    ids = {"c": 1, "d": 2, "x": 3}

    def one(i, p, t):
        words = (t or "").split()
        found = [ids[w] for w in words[:4] if w in ids]
        pad = [0] * (4 - len(found))
        return (i, p, len(words), tuple(found + pad), tuple([1] * len(found) + pad))

    assert Counter((r.doc_id, r.pos, r.n_tokens, tuple(r.input_ids), tuple(r.attention_mask)) for r in got) == Counter(
        one(*r) for r in ROWS)
