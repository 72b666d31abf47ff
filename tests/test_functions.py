"""Hand-computed cases for the reference's quirks (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from lectio.functions import levels as L
from lectio.functions import text as T
from lectio.operators import features as feat
from lectio.operators import rollup
from lectio.operators.segment import sentences


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,level", [(-0.4, 1), (0.5, 1), (1.5, 3), (2.5, 3), (17.5, 19), (18.6, 19), (40.0, 19)])
def test_score_to_level(spark, raw, level):
    assert one(spark, L.score_to_level, raw, "double") == level


def test_sentence_modes(spark):
    docs = spark.createDataFrame([(1, "a\n\n b \n")], "doc_id long, text string")
    raw = [r.sentence for r in sentences(docs, "raw").orderBy("pos").collect()]
    clean = [r.sentence for r in sentences(docs, "clean").orderBy("pos").collect()]
    untrimmed = [r.sentence for r in sentences(docs, "untrimmed").orderBy("pos").collect()]
    assert raw == ["a", "", " b ", ""]
    assert clean == ["a", "b"]
    assert untrimmed == ["a", " b "]


def test_lexical_features_example(spark):
    sent = spark.createDataFrame([(1, 0, "aa bbb"), (1, 1, "   ")], "doc_id long, pos int, sentence string")
    lex = spark.createDataFrame([("aa", 5.0)], "lemma string, score double")
    rows = {r.pos: r for r in feat.lexical_features(sent, lex).collect()}
    got = [rows[0][c] for c in feat.LEXICAL_NAMES]
    assert got == [6.0, 2.0, 2.5, 4.0, 5.0, 1.0, 0.5]
    assert [rows[1][c] for c in feat.LEXICAL_NAMES] == [0.0] * 7


def test_lexical_features_empty_lexicon(spark):
    sent = spark.createDataFrame([(1, 0, "aa bbb")], "doc_id long, pos int, sentence string")
    lex = spark.createDataFrame([], "lemma string, score double")
    r = feat.lexical_features(sent, lex).first()
    assert [r[c] for c in feat.LEXICAL_NAMES] == [0.0] * 7


def test_lemma_pos_scores_without_match(spark):
    toks = spark.createDataFrame([(1, 0, 0, "zz")], "doc_id long, pos int, tpos int, token string")
    an = spark.createDataFrame([], "word string, d3tok string, lex string, pos string")
    lp = spark.createDataFrame([("aa#noun", 4.0)], "lemma_pos string, score double")
    r = feat.lemma_pos_scores(toks, an, lp).first()
    assert (r.avg_readability, r.max_readability) == (0.0, 0.0)


def test_fill_missing_level(spark):
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    lv = spark.createDataFrame([(1, 7)], "doc_id long, level int")
    got = dict((r.doc_id, r.level) for r in rollup.fill_levels(ids, lv).collect())
    assert got == {1: 7, 2: 1}


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    assert df.select(L.argmax_index("v").alias("i")).first().i == 1


def test_clitic_rewrite(spark):
    assert one(spark, T.rewrite_clitics, "w+_al+_bnat_+h") == "w+ al+ bnat +h"


def test_normalize_chain(spark):
    src = "الْعَرَبِيَّةُ جميييييل أحمد إبراهيم مدرسة على،"
    assert one(spark, T.normalize, src) == "العربيه جميل احمد ابراهيم مدرسه علي"


def test_grade_parse_and_band(spark):
    assert one(spark, L.parse_grade, "G7") == 7
    assert one(spark, L.parse_grade, "Gx") is None
    assert one(spark, L.grade_band_level, "AE") == 6
    assert one(spark, L.grade_band_level, "XX") is None


def test_ensemble_clip(spark):
    preds = spark.createDataFrame([(1, 19), (1, 19), (1, 18), (2, 1), (2, 2)], "doc_id long, prediction int")
    got = dict((r.doc_id, r.level) for r in rollup.ensemble_levels(preds).collect())
    assert got == {1: 19, 2: 2}  # 18.67 -> 19 ; 1.5 -> 2 (half-to-even)


def test_doc_max_equals_max_of_levels(spark):
    sc = spark.createDataFrame([(1, 0, 2.5), (1, 1, 7.49), (2, 0, -3.0), (2, 1, 17.5)],
                               "doc_id long, pos int, raw double")
    a1 = dict((r.doc_id, r.level) for r in rollup.doc_level_from_raw(sc).collect())
    lv = sc.select("doc_id", L.score_to_level("raw").alias("level"))
    a2 = dict((r.doc_id, r.level) for r in rollup.doc_level_from_levels(lv).collect())
    assert a1 == a2 == {1: 8, 2: 19}


def test_encode_fixed_truncates_pads_and_maps_unknown(spark):
    from lectio.operators.encode import encode_fixed
    sent = spark.createDataFrame([(1, 0, "a b c d e"), (1, 1, "b zz")], "doc_id long, pos int, sentence string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("d", 5), ("e", 6)], "word string, id int")
    rows = {r.pos: r for r in encode_fixed(sent, vocab, max_len=4, unk_id=1).collect()}
    assert rows[0].input_ids == [2, 3, 4, 5] and rows[0].attention_mask == [1, 1, 1, 1] and rows[0].n_tokens == 5
    assert rows[1].input_ids == [3, 1, 0, 0] and rows[1].attention_mask == [1, 1, 0, 0]


def test_lexical_features_carry_text(spark):
    sent = spark.createDataFrame([(1, 0, "aa bbb", 7), (1, 1, "", 3)], "doc_id long, pos int, sentence string, label int")
    lex = spark.createDataFrame([("aa", 5.0)], "lemma string, score double")
    rows = {r.pos: r for r in feat.lexical_features(sent, lex, keep=("sentence", "label")).collect()}
    assert (rows[0].sentence, rows[0].label, rows[0].f_mean_diff) == ("aa bbb", 7, 4.0)
    assert (rows[1].sentence, rows[1].label, rows[1].f_chars) == ("", 3, 0.0)


def test_punct_separators_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "a; b. c-d")], "doc_id long, text string")
    default = [r.sentence for r in sentences(docs, "punct").orderBy("pos").collect()]
    custom = [r.sentence for r in sentences(docs, "punct", end_chars=";-").orderBy("pos").collect()]
    assert default == ["a; b.", "c-d"]
    assert custom == ["a;", "b. c-", "d"]


def test_lemma_lexicon_last_row_wins(spark):
    from lectio.operators.corpus import lemma_lexicon
    from lectio.session import scratch_path
    from lectio.sources import readers as R
    from lectio.sources import sinks as K
    rows = [("kitab#noun", 2), ("kataba#verb", 4), ("kitab#adj", 5), ("qalam#noun", 1)]
    df = spark.createDataFrame(rows, "`lemma#pos` string, `readability (rounded average)` int").coalesce(1)
    path = K.write_tsv(df, scratch_path(spark, "lexicon-file"))
    from pyspark.sql import types as ST
    schema = ST.StructType([ST.StructField("lemma#pos", ST.StringType()),
                            ST.StructField("readability (rounded average)", ST.IntegerType())])
    got = dict((r.lemma, r.score) for r in lemma_lexicon(R.read_tsv(spark, path, schema)).collect())
    assert got == {"kitab": 5.0, "kataba": 4.0, "qalam": 1.0}
