"""Property tests: Spark expressions vs the plain-Python behaviour they
reproduce, on generated inputs (one Spark job per generated batch)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectio.functions import levels as L
from lectio.functions import text as T
from lectio.operators import morph as MO
from lectio.operators.segment import sentences

ALPHABET = st.sampled_from(list("ab é.,!?") + ["\n", "\t", "\r", "\x0b", "ـ", "َ", "أ", "ة", "ى",
                                                "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\u200c"])
TEXTS = st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=30)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(TEXTS)
def test_sentence_modes_match_python(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for mode in ("raw", "clean", "untrimmed"):
        got[mode] = sorted((r.doc_id, r.pos, r.sentence) for r in sentences(docs, mode).collect())
    ws = T.WS_CHARS
    want_raw = sorted((i, p, s) for i, t in enumerate(texts) for p, s in enumerate(t.split("\n")))
    want_clean = sorted((i, p, s.strip(ws)) for i, t in enumerate(texts)
                        for p, s in enumerate(t.split("\n")) if s.strip(ws))
    want_untrimmed = sorted((i, p, s) for i, t in enumerate(texts)
                            for p, s in enumerate(t.split("\n")) if s.strip(ws))
    assert got["raw"] == want_raw
    assert got["clean"] == want_clean
    assert got["untrimmed"] == want_untrimmed


@SETTINGS
@given(TEXTS)
def test_whitespace_tokens_match_str_split(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.toks for r in df.select(T.whitespace_tokens("t").alias("toks")).collect()]
    assert got == [t.split() for t in texts]


@SETTINGS
@given(st.lists(st.floats(min_value=-50, max_value=60, allow_nan=False).map(lambda x: round(x * 2) / 2 if x > 0 else x),
                min_size=1, max_size=50))
def test_score_to_level_matches_numpy(spark, raws):
    df = spark.createDataFrame([(float(x),) for x in raws], "raw double")
    got = [r.level for r in df.select(L.score_to_level("raw").alias("level")).collect()]
    want = (np.clip(np.round(np.array(raws, dtype=float)), 0, 18) + 1).astype(int).tolist()
    assert got == want


@SETTINGS
@given(TEXTS)
def test_untouched_words_reassemble_to_squeezed_input(spark, texts):
    """with no analyses every token is written as is, so the segmented
    text is the tokens joined by single spaces."""
    import regex
    sent = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, sentence string")
    empty = spark.createDataFrame([], "word string, d3tok string, lex string, pos string, d3tok_form string")
    got = dict((r.doc_id, r.d3tok_text) for r in MO.morph_text(sent, empty).collect())
    ws = regex.escape(T.WS_CHARS)
    pat = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^" + ws + r"\p{L}\p{M}\p{N}_]")
    want = {i: " ".join(pat.findall(t)) for i, t in enumerate(texts)}
    assert got == want


@SETTINGS
@given(TEXTS)
def test_dediac_removes_exactly_the_marks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(T.dediac("t").alias("d")).collect()]
    marks = set(T.DIACRITICS)
    assert got == ["".join(ch for ch in t if ch not in marks) for t in texts]


@SETTINGS
@given(TEXTS)
def test_fused_normalize_equals_step_chain(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chain = F.col("t")
    for _, step in T.NORMALIZE_STEPS:
        chain = step(chain)
    rows = df.select(T.normalize("t").alias("a"), chain.alias("b")).collect()
    assert all(r.a == r.b for r in rows)
