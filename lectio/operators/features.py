"""Sentence feature vectors.

Plan shape for every builder: explode the sentence's tokens (narrow),
one checked-broadcast lookup join, one ``groupBy`` on the sentence key.  The
aggregation runs partially on the map side — all tokens of a sentence sit
in the partition that exploded them — so the shuffle carries one partial
row per sentence, never the token rows.  Averages are integer (or
integer-valued) sums divided once, so results do not depend on the order in
which partial sums are merged.

Rows, not ids, are the sentences.  An id may be null or come twice, so token
rows are grouped by the id and a 128-bit hash of the text (:func:`keyed`).  Rows
that are alike in both form one group; it counts them by their first tokens,
its sums are divided by their number, and it gives as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators.joins import hot_sample, lookup_join
from lectio.session import stored_rows

ID_COLS = ("doc_id", "pos")
LEXICAL_NAMES = ("f_chars", "f_words", "f_mean_len", "f_mean_diff",
                 "f_max_diff", "f_n_hard", "f_oov_share")
DEFAULT_DIFFICULTY = 3.0
HARD_ABOVE = 4.0


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


#: Columns that tell rows with the same id apart, and the number of equal rows.
ROW_KEYS = ("_k1", "_k2")
COPIES = "_copies"


def keyed(sentences: DataFrame, text_col: str = "sentence") -> DataFrame:
    """``sentences`` with the hash of the text in :data:`ROW_KEYS`."""
    text = F.col(text_col)
    return sentences.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})


def count_rows(tpos: str = "tpos"):
    """How many rows the token rows of a group come from: every row has a
    first token, or one null token."""
    place = F.col(tpos)
    return F.count(F.when(place.isNull() | (place == 0), 1)).alias(COPIES)


def per_row(total, whole: bool = True):
    """A group's sum as that of one of its equal rows."""
    one = F.col(COPIES) == 1
    return F.when(one, total).otherwise((total / F.col(COPIES)).cast("long") if whole else total / F.col(COPIES))


def repeated(groups: DataFrame) -> DataFrame:
    """One row for each of a group's equal rows."""
    n = F.col(COPIES).cast("int")
    return groups.withColumn(COPIES, F.explode(F.array_repeat(F.lit(1), n))).drop(COPIES)


def rejoin(groups: DataFrame, sentences: DataFrame, id_cols, text_col: str, keep, how: str = "inner") -> DataFrame:
    """Every row of ``sentences`` with its group's columns and its own
    ``keep``; a null id meets a null id.  ``how='right'`` keeps rows without
    a group."""
    on = [*id_cols, *ROW_KEYS]
    rows = keyed(sentences.select(*id_cols, *keep, F.col(text_col).alias("_text")), "_text").drop("_text")
    rows = rows.select(*[F.col(c).alias(f"_r_{c}") for c in on], *keep)
    same = [groups[c].eqNullSafe(rows[f"_r_{c}"]) for c in on]
    joined = groups.join(rows, same, how)
    rest = [c for c in groups.columns if c not in (*on, COPIES)]
    return joined.select(*[rows[f"_r_{c}"].alias(c) for c in id_cols], *rest, *keep)


def explode_tokens(sentences: DataFrame, id_cols=ID_COLS, text_col: str = "sentence",
                   tokenizer=T.whitespace_tokens, keep: tuple = ()) -> DataFrame:
    """``(id.., *keep, tpos, token)``; a sentence without tokens keeps one
    row with null ``token`` so it survives to the aggregation."""
    return sentences.select(*id_cols, *keep,
                            F.posexplode_outer(tokenizer(F.col(text_col))).alias("tpos", "token"))


def lexical_sums(sentences: DataFrame, lexicon: DataFrame, id_cols=ID_COLS,
                 text_col: str = "sentence", default: float = DEFAULT_DIFFICULTY,
                 hard_above: float = HARD_ABOVE, keep: tuple = (), fold_case: bool = False,
                 order_col: str | None = None) -> DataFrame:
    """Integer sums behind A4: n_chars, n_words, sum_len, sum_diff,
    max_diff, n_hard, n_oov per sentence.  ``lexicon``: ``(lemma, score)``,
    looked up as written; ``fold_case`` lower-cases lemmas and tokens.  A
    lemma that comes twice counts once (see :func:`one_score`).  ``keep``:
    per-sentence columns, joined back to the sums by id and text hash so that
    no token row holds them.  One row per row of ``sentences``."""
    sent = keyed(sentences.select(*id_cols, F.length(text_col).alias("n_chars"), text_col), text_col)
    word = F.lower("token") if fold_case else F.col("token")
    # a token row that is shuffled holds its word once
    toks = explode_tokens(sent, id_cols, text_col, keep=("n_chars", *ROW_KEYS)).select(
        *id_cols, "n_chars", *ROW_KEYS, "tpos", F.length("token").alias("_len"), word.alias("word"))
    probe = explode_tokens(hot_sample(sentences), (), text_col).select(word.alias("word"))
    joined = lookup_join(toks, one_score(lexicon, fold_case, order_col), "word", "left", probe=probe)
    present = F.col("_len").isNotNull()
    d = F.when(present, F.coalesce(F.col("score"), F.lit(default)))
    sums = joined.groupBy(*id_cols, "n_chars", *ROW_KEYS).agg(
        count_rows(),
        F.count("_len").alias("n_words"),
        F.coalesce(F.sum("_len"), F.lit(0)).alias("sum_len"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("sum_diff"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_diff"),
        F.count(F.when(d > hard_above, 1)).alias("n_hard"),
        F.count(F.when(present & F.col("score").isNull(), 1)).alias("n_oov"),
    )
    whole = {c: per_row(F.col(c)) for c in ("n_words", "sum_len", "n_hard", "n_oov")}
    sums = sums.withColumns(whole | {"sum_diff": per_row(F.col("sum_diff"), whole=False)})
    return rejoin(sums, sentences, id_cols, text_col, keep) if keep else repeated(sums).drop(*ROW_KEYS)


def one_score(lexicon: DataFrame, fold_case: bool = False, order_col: str | None = None) -> DataFrame:
    """``(word, score)`` with one row per word: the last by ``order_col``
    (A11), or the highest score where the lexicon has no order.  A dictionary
    (``word``, ``score``) as :func:`dictionary` stores it is taken as it is."""
    if "word" in lexicon.columns:
        return lexicon.select("word", "score")
    lemma = F.lower("lemma") if fold_case else F.col("lemma")
    score = F.col("score").cast("double")
    pick = F.max_by("score", "o") if order_col else F.max("score")
    order = F.struct(F.col(order_col), score).alias("o") if order_col else F.lit(None).alias("o")
    return lexicon.select(lemma.alias("word"), score.alias("score"), order).groupBy("word").agg(pick.alias("score"))


def dictionary(lexicon: DataFrame, fold_case: bool = False, order_col: str | None = None) -> DataFrame:
    """The lexicon as a stored lookup table, one row per word.  Made once, it
    spares every later plan (each micro-batch, each query) the aggregation."""
    return stored_rows(one_score(lexicon, fold_case, order_col), "dictionary")


def features_from_sums(sums: DataFrame, id_cols=ID_COLS, keep: tuple = ()) -> DataFrame:
    """A4's seven slots from :func:`lexical_sums`; no words -> seven zeros."""
    n = F.col("n_words")
    some = n > 0
    return sums.select(
        *id_cols, *keep,
        F.when(some, F.col("n_chars").cast("double")).otherwise(0.0).alias("f_chars"),
        n.cast("double").alias("f_words"),
        _ratio(F.col("sum_len"), n).alias("f_mean_len"),
        _ratio(F.col("sum_diff"), n).alias("f_mean_diff"),
        F.col("max_diff").cast("double").alias("f_max_diff"),
        F.col("n_hard").cast("double").alias("f_n_hard"),
        _ratio(F.col("n_oov"), n).alias("f_oov_share"),
    )


def zero_features(sentences: DataFrame, id_cols=ID_COLS) -> DataFrame:
    return sentences.select(*id_cols, *[F.lit(0.0).alias(c) for c in LEXICAL_NAMES])


def lexical_features(sentences: DataFrame, lexicon: DataFrame | None, id_cols=ID_COLS,
                     text_col: str = "sentence", keep: tuple = (), fold_case: bool = False,
                     order_col: str | None = None) -> DataFrame:
    """A4: the 7-feature vector per sentence as seven columns.

    Slots: characters, words, mean word length, mean difficulty (absent
    words count 3.0), max difficulty, words harder than 4, share of words
    not in the lexicon.  An empty or missing lexicon gives seven zeros.
    """
    if lexicon is not None and "word" not in lexicon.columns:
        # a derived lexicon is computed once, not for every look at its size
        lexicon = dictionary(lexicon, fold_case, order_col)
    if lexicon is None or lexicon.isEmpty():
        return zero_features(sentences, tuple(id_cols) + tuple(keep))
    sums = lexical_sums(sentences, lexicon, id_cols, text_col, keep=keep, fold_case=fold_case)
    return features_from_sums(sums, id_cols, keep)


def as_vector(df: DataFrame, names=LEXICAL_NAMES, out: str = "features") -> DataFrame:
    """Pack feature columns into one ``array<double>`` column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in names]))


def lemma_pos_scores(tokens: DataFrame, analyses: DataFrame, lemma_pos_lexicon: DataFrame,
                     id_cols=ID_COLS) -> DataFrame:
    """A3 (with J8 + F14 + J3): mean and max score of matched ``lemma#pos``.

    ``tokens``: ``(id.., tpos, token)``; ``analyses``: one row per word
    with ``lex`` and ``pos``; ``lemma_pos_lexicon``: ``(lemma_pos, score)``.
    Unmatched keys are skipped; a sentence without matches scores 0.0.  With
    :data:`ROW_KEYS` among the tokens' columns every sentence row has its own
    result; without them rows with one id are one sentence.
    """
    from lectio.operators.morph import analyse_tokens, scored_analyses

    keys = [c for c in ROW_KEYS if c in tokens.columns]
    scored = analyse_tokens(tokens, scored_analyses(analyses, lemma_pos_lexicon))
    found = scored.groupBy(*id_cols, *keys).agg(*([count_rows()] if keys else []), *score_aggregates())
    return repeated(found).drop(*keys) if keys else found


def score_aggregates() -> list:
    """A3's mean and maximum over matched keys (equal rows change neither)."""
    return [_ratio(F.coalesce(F.sum("lp_score"), F.lit(0.0)), F.count("lp_score")).alias("avg_readability"),
            F.coalesce(F.max("lp_score"), F.lit(0.0)).alias("max_readability")]


def sparse_from_scores(scores: DataFrame, id_cols=ID_COLS) -> DataFrame:
    """A5: 7 slots = mean score, max score, five zeros."""
    return scores.select(
        *id_cols,
        F.col("avg_readability").alias("f1"), F.col("max_readability").alias("f2"),
        *[F.lit(0.0).alias(f"f{i}") for i in range(3, 8)])


def surface_features(sentences: DataFrame, id_cols=ID_COLS, text_col: str = "sentence") -> DataFrame:
    """7 slots = word count, character count, mean word length (over
    punctuation-separating tokens), four zeros.  Pure array expressions:
    no explode, no shuffle."""
    toks = T.word_tokens(F.col(text_col))
    n = F.size(toks)
    total = F.aggregate(toks, F.lit(0).cast("long"), lambda acc, t: acc + F.length(t))
    return sentences.select(
        *id_cols,
        n.cast("double").alias("f1"),
        F.length(text_col).cast("double").alias("f2"),
        _ratio(total, n).alias("f3"),
        *[F.lit(0.0).alias(f"f{i}") for i in range(4, 8)])
