"""Morphological rewrite of sentences.

The reference runs a neural disambiguator word by word and keeps the top
analysis.  Here the analyser's output is a table ``(word, d3tok, lex, pos,
score)``; the top analysis per word is chosen once (a keyed aggregation on
that small table), then tokens are looked up with a checked broadcast join.
Words without an analysis keep their surface form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators.features import (COPIES, ID_COLS, ROW_KEYS, count_rows, explode_tokens, keyed, repeated,
                                       score_aggregates)
from lectio.operators.joins import hot_sample, lookup_join


def first_analysis(analyses: DataFrame) -> DataFrame:
    """One analysis per word: the highest score; ties by the larger
    (d3tok, lex, pos).  A hash aggregation, no sort.  The written form of
    the analysis (clitic markers rewritten, diacritics removed; null when
    the d3tok is missing or blank) is computed here, once per word, not
    once per token."""
    best = F.max(F.struct(F.col("score"), F.col("d3tok"), F.col("lex"), F.col("pos")))
    d = F.col("d3tok")
    return (analyses.groupBy("word").agg(best.alias("a"))
            .select("word", F.col("a.d3tok").alias("d3tok"), F.col("a.lex").alias("lex"),
                    F.col("a.pos").alias("pos"))
            .withColumn("d3tok_form", F.when(d.isNotNull() & T.has_text(d),
                                             T.dediac(T.rewrite_clitics(d)))))


def analyse_tokens(tokens: DataFrame, analyses: DataFrame, only: tuple = (), probe: DataFrame | None = None) -> DataFrame:
    """``tokens`` + ``d3tok``/``d3tok_form``/``lex``/``tag`` (part of
    speech) of the word (lower-cased lookup); null when the word has no
    analysis.  ``analyses`` holds one row per word (:func:`first_analysis`);
    ``only`` names the columns to look up, ``probe`` is a sample of the words."""
    keyed = tokens.withColumn("word", F.lower("token"))
    cols = ["word", "d3tok", "lex", F.col("pos").alias("tag")]
    cols += [c for c in ("d3tok_form", "lp_score") if c in analyses.columns]
    found = analyses.select(*cols)
    return lookup_join(keyed, found.select("word", *only) if only else found, "word", "left", probe=probe)


def scored_analyses(analyses: DataFrame, lemma_pos_lexicon: DataFrame) -> DataFrame:
    """J3 + F14 once per analysed word: the word's ``lemma#pos`` key depends
    only on its analysis, so its lexicon score is looked up here, on the
    (small) analyses table, instead of once per token occurrence."""
    keyed = analyses.withColumn("lemma_pos", T.lemma_pos_key("lex", "pos"))
    lex = lemma_pos_lexicon.select("lemma_pos", F.col("score").cast("double").alias("lp_score"))
    return lookup_join(keyed, lex, "lemma_pos", "left", skew_safe=False).drop("lemma_pos")


def segmented_form(c_token="token", c_form="d3tok_form"):
    """Form written for a token: its analysis form, else the word itself,
    verbatim."""
    return F.coalesce(F.col(c_form), F.col(c_token))


def replaced_forms(words: Column, changes: Column) -> Column:
    """``words`` joined by spaces, those at the places of ``changes``
    (an array of ``tpos``, ``form``, in any order) by their forms."""
    places = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), F.transform(changes, lambda c: c["tpos"]))
    plain = F.transform(places, lambda p: F.struct(p.alias("tpos"), F.get(words, p).alias("form")))
    forms = F.transform(F.array_sort(F.concat(plain, changes)), lambda c: c["form"])
    return F.when(F.size(changes) > 0, F.array_join(forms, " ")).otherwise(F.array_join(words, " "))


def morph_text(sentences: DataFrame, analyses: DataFrame, id_cols=ID_COLS,
               text_col: str = "sentence", lemma_pos_lexicon: DataFrame | None = None,
               keep: tuple = ()) -> DataFrame:
    """Segmented text per sentence, plus (when a ``lemma#pos`` lexicon
    is given) A3's mean/max scores.  ``keep``: per-sentence columns (e.g. the
    label).  One row per row of ``sentences``, whatever its id.

    Most words are written as they are.  The sentence goes with its first
    token, and only that row and those of words with another form are gathered,
    so that a sentence is shuffled as one text, not as its token rows.
    """
    # A null or blank sentence is segmented to ""
    sent = sentences.select(*id_cols, *keep, T.blank_to_empty(text_col).alias("_sentence"))
    toks = explode_tokens(keyed(sent, "_sentence"), id_cols, "_sentence", tokenizer=T.word_tokens,
                          keep=(*keep, *ROW_KEYS, "_sentence"))
    first = F.col("tpos").isNull() | (F.col("tpos") == 0)
    toks = toks.withColumn("_sentence", F.when(first, F.col("_sentence")))
    probe = explode_tokens(hot_sample(sent), (), "_sentence", tokenizer=T.word_tokens).select(F.lower("token").alias("word"))
    only = ("d3tok_form",)
    if lemma_pos_lexicon is not None:
        analyses, only = scored_analyses(analyses, lemma_pos_lexicon), ("d3tok_form", "lp_score")
    analysed = analyse_tokens(toks, analyses, only, probe).withColumn("form", segmented_form())
    other = F.coalesce(F.col("form") != F.col("token"), F.lit(False))
    # equal rows are grouped together: a change of theirs counts once
    aggs = [count_rows(), F.max("_sentence").alias("_sentence"),
            F.collect_set(F.when(other, F.struct("tpos", "form"))).alias("_changes")]
    if lemma_pos_lexicon is not None:
        aggs += score_aggregates()
    else:
        analysed = analysed.filter(first | other)
    found = analysed.groupBy(*id_cols, *keep, *ROW_KEYS).agg(*aggs).withColumn("_words", T.word_tokens("_sentence"))
    text = replaced_forms(F.col("_words"), F.col("_changes")).alias("d3tok_text")
    scores = [] if lemma_pos_lexicon is None else ["avg_readability", "max_readability"]
    return repeated(found.select(*id_cols, *keep, text, *scores, COPIES))
