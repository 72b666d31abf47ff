"""SpotSigs fingerprints: signatures at common-word anchors.

An anchor is a common word.  Its signature is the anchor with the next content
words (words that are no anchors).  The distinct signatures of a text are its
set; a text without any has one signature made of the whole text, so equal
texts always have equal sets.  The fingerprint is a 128-bit hash of the sorted
set, and two sets are compared by Jaccard.

Sets are partitioned by length into classes whose bounds grow by the threshold,
so similar sets lie in one class or in neighbouring ones.  With a threshold, a
pair whose lengths alone rule it out is pruned before its sets are intersected;
without one, likeness is exact for every pair.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import text_or_empty
from lectio.operators.joins import lookup_join
from lectio.operators.sequence import with_row_number

#: Common words (fixed values; English, German, French, Spanish).
ANCHORS = {
    "en": "a an the of and or to in on at by for with from as is are was were be been it its this that",
    "de": "der die das den dem des ein eine einen und oder zu in im am auf mit von für ist sind war es sie er nicht",
    "fr": "le la les un une des du de et ou à au aux en dans par pour sur est sont ce que qui il elle",
    "es": "el la los las un una de del y o a al en por para con es son se que lo su no",
}
#: Content words of a signature.
CHAIN = 2
THRESHOLD = 0.75
#: Rows that share an id, or have none, are joined in shares of about so many.
SHARE_ROWS = 1 << 12
_END = "\x01"


def anchor_words(anchors: dict[str, str] = ANCHORS) -> list[str]:
    return sorted({w for words in anchors.values() for w in words.split()}, key=lambda w: (-len(w), w))


def with_signatures(df: DataFrame, text: Column, out: str, chain: int = CHAIN,
                    anchors: dict[str, str] = ANCHORS) -> DataFrame:
    """Add the sorted distinct signatures of ``text`` (array<bigint>) as
    ``out``.  Null text: null."""
    words, content, chained, raw = (f"_{out}_{c}" for c in ("words", "content", "chain", "raw"))
    anchor = anchor_words(anchors)
    plain = F.trim(F.regexp_replace(F.lower(F.col(raw)), r"[^\p{L}\p{N}]+", " "))
    # a content word ends its piece, an anchor leads the one it is in; the
    # last word of the text counts as content
    marked = F.array_join(F.transform(F.split(plain, " "), lambda w: F.when(
        w.isin(anchor), F.concat(w, F.lit(" "))).otherwise(F.concat(w, F.lit(_END)))), "")
    df = df.withColumn(raw, text)
    df = df.withColumn(words, F.split(F.rtrim(marked, F.lit(" " + _END)), _END))
    df = df.withColumn(content, F.transform(words, lambda e: F.substring_index(e, " ", -1)))
    links = F.col(content)
    for i in range(1, chain):
        links = F.zip_with(links, F.slice(F.col(content), i + 1, F.greatest(F.size(content), F.lit(1))),
                           lambda a, b: F.concat_ws(" ", a, b))
    zipped = F.arrays_zip(F.col(words).alias("e"), F.col(content).alias("w"), links.alias("c"))
    df = df.withColumn(chained, F.filter(zipped, lambda x: F.instr(x["e"], " ") > 0))
    found = F.flatten(F.transform(chained, lambda x: F.transform(
        F.split(F.substr(x["e"], F.lit(1), F.char_length(x["e"]) - F.char_length(x["w"]) - 1), " "),
        lambda a: F.xxhash64(a, x["c"]))))
    df = df.withColumn(out, F.array_sort(F.array_distinct(found)))
    df = df.withColumn(out, F.when(F.size(out) == 0, F.array(F.xxhash64(F.lit("text"), F.col(raw)))).otherwise(F.col(out)))
    return df.drop(words, content, chained, raw)


def digest(signatures: Column) -> Column:
    """128 bits of a sorted set, as lowercase hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), signatures)), 16, "0") for seed in (1, 2)]))


def likeness(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Jaccard of two sets.  With a threshold, sets whose lengths alone keep
    them below it are not intersected and count as 0."""
    shared = F.size(F.array_intersect(a, b))
    value = shared / (F.size(a) + F.size(b) - shared)
    if threshold is None:
        return value
    return F.when(F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b)), value).otherwise(0.0)


def length_class(signatures: Column, threshold: float = THRESHOLD) -> Column:
    """Sets that reach the threshold lie in one class or neighbouring ones."""
    return F.floor(F.log(F.size(signatures)) / math.log(1 / threshold) + 1e-9).cast("int")


def ring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (characters), ``h`` (hash) and ``rows`` of each distinct
    id (null is one) and, of the one that precedes it in descending order,
    ``prev_id``, ``prev_n`` and ``prev_rows``; the first follows the last.

    Only ids and lengths are sorted.  ``n`` and ``h`` are those of the longest
    text of the id (of those, by hash).
    """
    n, h = F.char_length(text_or_empty(text_col)), F.xxhash64(text_or_empty(text_col))
    ids = (docs.select(F.col(id_col).alias("id"), F.struct(n.cast("long").alias("n"), h.alias("h")).alias("s"))
           .groupBy("id").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("rows")).select("id", "s.n", "s.h", "rows"))
    placed = with_row_number(ids, [F.desc_nulls_last("id")], "r")
    total = placed.count()
    before = placed.select((F.col("r") % F.lit(max(total, 1)) + 1).alias("r"), F.col("id").alias("prev_id"),
                           F.col("n").alias("prev_n"), F.col("rows").alias("prev_rows"))
    return placed.join(before, "r").drop("r")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN,
                anchors: dict[str, str] = ANCHORS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Every row with the fingerprints and signatures of its text and of its
    edited text, and those of the next document: ``id_col``, text, edited,
    fingerprint, edited_fingerprint, next_fingerprint and signatures,
    edited_signatures, next_signatures (array<bigint>).  Whoever uses all of them
    lets Spark shuffle the documents once: both roles read the same columns.

    The edited text has the last half (floor) of the row's characters replaced
    by as many from the start of the next document in descending id.  A
    row's text moves once, and the part of it that its neighbour needs once
    more.  Null text counts as empty.  Rows that repeat an id, or have none,
    stay: each has the same next document, and to the preceding id the longest
    of their texts is the next (see :func:`ring`).  They are dealt in shares of
    about ``share_rows``, each with its copy of the next document.
    """
    around = ring(docs, id_col, text_col)
    around = around.select(*_key("id", ""), "n", "h", _shares("rows", share_rows).alias("shares"),
                           *_key("prev_id", "to_"), "prev_n", _shares("prev_rows", share_rows).alias("to_shares"))
    # the place in its file deals a row, because rows may be equal
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("place"))
    # Signatures are made where they are compared, so that of a row only its text
    # moves.  Ids are joined as a value and a mark for null.
    rows = rows.select(*_key("id", ""), "place", "text", F.char_length("text").cast("long").alias("text_n"))
    hot = around.filter("shares > 1").select("key", "absent", "shares")
    rows = lookup_join(rows, hot, ["key", "absent"])
    rows = rows.withColumn("share", F.coalesce(F.expr("pmod(place, shares)"), F.lit(0))).drop("place", "shares")
    parts = ["key", "absent", "share"]
    # written so that it does not become a part of the join's key: the next
    # join can then go on with the same partitioning
    own = (rows.join(_copies(around, "shares"), parts)
           .filter("text_n - n = 0 AND (xxhash64(text) ^ h) = 0").dropDuplicates(parts))
    own = with_signatures(own, F.col("text"), "signatures", chain, anchors)
    sent = own.select(F.col("to_key").alias("key"), F.col("to_absent").alias("absent"), "to_shares",
                      F.expr("substring(text, 1, CAST(prev_n DIV 2 AS INT))").alias("head"),
                      digest(F.col("signatures")).alias("next_fingerprint"), F.col("signatures").alias("next_signatures"))
    both = rows.join(_copies(sent, "to_shares").dropDuplicates(parts), parts)
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, CAST(text_n - text_n DIV 2 AS INT))"),
                                              F.expr("substring(head, 1, CAST(text_n DIV 2 AS INT))")))
    both = with_signatures(both, F.col("text"), "signatures", chain, anchors)
    both = with_signatures(both, F.col("edited"), "edited_signatures", chain, anchors)
    return both.select(F.when(~F.col("absent"), F.col("key")).alias(id_col), "text", "edited",
                       digest(F.col("signatures")).alias("fingerprint"),
                       digest(F.col("edited_signatures")).alias("edited_fingerprint"), "signatures",
                       "edited_signatures", "next_fingerprint", "next_signatures")


def _shares(rows: str, share_rows: int) -> Column:
    return F.ceil(F.col(rows) / share_rows)


def _copies(df: DataFrame, shares: str) -> DataFrame:
    """A copy of each row for every share, numbered ``share``."""
    return df.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col(shares) - 1))).drop(shares)


def _key(c: str, prefix: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)).alias(f"{prefix}key"), F.col(c).isNull().alias(f"{prefix}absent")]
