"""Document -> sentence tables.

Each mode is one ``posexplode`` over an array expression: a narrow
transformation, no shuffle, and the document key travels with every
sentence so later roll-ups are key aggregations, never positional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import text as T

MODES = ("raw", "clean", "untrimmed", "punct")


def sentences(docs: DataFrame, mode: str = "clean", id_col: str = "doc_id",
              text_col: str = "text", keep: tuple = (), end_chars: str = T.SENTENCE_END_CHARS) -> DataFrame:
    """Split documents into ``(id, pos, sentence, *keep)`` rows.

    * ``raw``       (F1): split on ``\\n``, blanks kept, null text dropped.
    * ``clean``     (F2): pieces stripped, blank pieces dropped.
    * ``untrimmed`` (F3): blank pieces dropped, the piece kept as is.
    * ``punct``     (F4): split after sentence-final punctuation, stripped,
      blanks dropped; ``pos`` counts the kept sentences.

    Otherwise ``pos`` is the 0-based position of the piece in the
    unfiltered split.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "punct":
        # numbered after blank removal: the engines' splitters may differ in
        # the empty pieces they produce between adjacent separators
        pieces = F.filter(F.transform(T.split_punct(F.col(text_col), end_chars), T.strip_ws),
                          lambda x: x != F.lit(""))
        return docs.select(id_col, *keep, F.posexplode(pieces).alias("pos", "sentence")) \
            .select(id_col, "pos", "sentence", *keep)
    exploded = docs.select(id_col, *keep, F.posexplode(T.split_lines(F.col(text_col))).alias("pos", "piece"))
    if mode == "raw":
        out = exploded.withColumnRenamed("piece", "sentence")
    elif mode == "untrimmed":
        out = exploded.filter(T.has_text("piece")).withColumnRenamed("piece", "sentence")
    else:
        # explode, then trim and filter: all inside whole-stage codegen
        out = (exploded.select(id_col, *keep, "pos", T.strip_ws("piece").alias("sentence"))
               .filter(F.col("sentence") != F.lit("")))
    return out.select(id_col, "pos", "sentence", *keep)


def sentences_from_list(docs: DataFrame, id_col: str = "doc_id", list_col: str = "text") -> DataFrame:
    """Sentences from a JSON/Python-style list literal.

    Unparsable values parse to null and empty lists explode to nothing, so
    both are skipped, as in the reference's ``try/except`` loop.
    """
    parsed = F.from_json(F.col(list_col), "array<string>")
    return (docs.select(id_col, F.posexplode(parsed).alias("pos", "sentence"))
            .filter(F.col("sentence").isNotNull()))


def parse_float_list(c, width: int | None = None):
    """A ``[f1, f2, ...]`` text column -> ``array<double>``."""
    arr = F.from_json(F.col(c) if isinstance(c, str) else c, "array<double>")
    if width is not None:
        arr = F.when(F.size(arr) == width, arr)
    return arr


def sentences_with(docs: DataFrame, splitter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V3: document -> sentences through a user Python splitter
    (``str -> list[str]``), as an Arrow-optimised Python UDTF.  Use only
    when the splitting rule cannot be written as the built-in expressions
    of :func:`sentences`; the document key travels with every row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos: int, sentence: string", useArrow=True)
    class _Split:
        def eval(self, text: str):
            if text is None:
                return
            for i, s in enumerate(splitter(text)):
                yield i, s

    return docs.select(id_col, text_col).lateralJoin(
        _Split(F.col(text_col).outer()).alias("s")) \
        .select(F.col(id_col), F.col("s.pos").alias("pos"), F.col("s.sentence").alias("sentence"))
