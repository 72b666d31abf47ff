"""Fixed-length id encoding (M9), re-aimed at whole words.

Vocabulary = distinct lower-cased tokens ranked by frequency (ties by the
token): a map-side-combined count, then a distributed numbering.  Only the
first ``max_len`` tokens of a sentence are looked up, so the join and the
per-sentence ``collect_list`` are bounded by ``max_len`` whatever the text
length.  Id 0 is padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators.features import ID_COLS, ROW_KEYS, explode_tokens, keyed, rejoin
from lectio.operators.joins import lookup_join
from lectio.operators.sequence import with_row_number
from lectio.session import cut_lineage

MAX_LEN = 256


def vocabulary(tokens: DataFrame, token_col: str = "word") -> DataFrame:
    """``(word, id)``: id 1 = most frequent word; ties by the word."""
    counts = tokens.groupBy(token_col).agg(F.count(F.lit(1)).alias("cnt"))
    return (with_row_number(counts, [F.desc("cnt"), F.asc(token_col)], "id")
            .select(token_col, F.col("id").cast("int").alias("id")))


def encode_fixed(sentences: DataFrame, vocab: DataFrame | None = None, id_cols=ID_COLS,
                 text_col: str = "sentence", max_len: int = MAX_LEN, unk_id: int | None = None) -> DataFrame:
    """``(id.., n_tokens, input_ids int[max_len], attention_mask int[max_len])``:
    the first ``max_len`` ids (the fixed-length contract), padded with 0,
    mask 1 for real tokens; ``n_tokens`` is the sentence's full token count,
    so what the cut leaves out stays visible.  With a user ``vocab``,
    unknown words map to ``unk_id`` (or are skipped when it is None); a
    vocabulary fitted here covers every token of every text.

    Every row has its result, whatever its id: one without tokens, or with
    unknown words only, is all padding."""
    sent = sentences.select(*id_cols, text_col,
                            F.size(T.whitespace_tokens(F.col(text_col))).alias("n_tokens"))
    toks = (explode_tokens(keyed(sent, text_col), id_cols, text_col, tokenizer=T.whitespace_tokens, keep=ROW_KEYS)
            .filter(F.col("token").isNotNull())
            .withColumn("word", F.lower("token")))
    if vocab is None:
        # fitted state: materialised once (reliable checkpoint) so the size
        # check and the lookup read it instead of recounting the corpus
        vocab = cut_lineage(vocabulary(toks.select("word")))
    head = toks.filter(F.col("tpos") < max_len)
    if unk_id is None:
        ided = lookup_join(head, vocab, "word", "inner")
    else:
        ided = lookup_join(head, vocab, "word", "left").withColumn("id", F.coalesce("id", F.lit(unk_id)))
    pairs = F.collect_list(F.struct(F.col("tpos"), F.col("id")))
    # equal rows, grouped together, give each token more than once
    pairs = F.array_sort(F.array_distinct(pairs))
    found = ided.groupBy(*id_cols, *ROW_KEYS).agg(F.transform(pairs, lambda x: x["id"]).alias("ids"))
    enc = rejoin(found, sent, id_cols, text_col, ["n_tokens"], how="right")
    enc = enc.withColumn("n_tokens", F.greatest("n_tokens", F.lit(0)))
    enc = enc.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    n = F.size("ids")
    pad = F.greatest(F.lit(0), F.lit(max_len) - n)
    return enc.select(
        *id_cols, "n_tokens",
        F.concat(F.slice("ids", 1, max_len), F.array_repeat(F.lit(0), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(max_len))), F.array_repeat(F.lit(0), pad))
        .alias("attention_mask"))
