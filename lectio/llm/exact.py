"""Exact deduplication by a 128-bit content hash, with the bytes compared.

Only hashes travel to find the groups.  The texts of groups with more than one
row are then held against the text of the row that stays, byte for byte; a row
that differs from it (a collision) is grouped by its own text instead.

Texts of a group are compared in shares: a group's rows are dealt by id over
one share per ``SHARE_ROWS`` rows, each with its copy of the staying text, so a
group that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import fold_ascii, stage, text_or_empty

SHARE_ROWS = 256


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, keep: str = "smallest", fold: bool = True, id_col: str = "doc_id",
                text_col: str = "text", share_rows: int = SHARE_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept and
    text_sha256 (of the compared text).

    ``keep`` names the id that stays in a group: the smallest or the largest.
    ``fold`` compares with A-Z lower-cased.  Null text counts as empty.  A
    null id never stays unless its group has no other; rows that repeat one id
    in a group are the same document, and ``kept`` says the same for each.
    Other columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = fold_ascii(text_or_empty(text_col)) if fold else text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))

    hashes = stage(rows.select("id", content_hash(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")),
                   "exact-hashes")
    groups = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep"), F.max("sha").alias("sha"))
    # written first: Spark can split a frequent key of a join whose sides are plain shuffles
    several = stage(groups.filter("n > 1").select("h", "n", "keep"), "exact-groups")

    # texts of the groups with several rows, each row with its share's number
    members = (rows.withColumn("h", content_hash(F.col("t"))).join(several, "h")
               .withColumn("shares", F.ceil(F.col("n") / share_rows).cast("int")))
    staying = members.filter(F.col("id").eqNullSafe(F.col("keep")))
    staying = (staying.groupBy("h").agg(F.max("t").alias("stays"), F.max("shares").alias("shares"))
               .select("h", "stays", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))
    compared = stage(
        members.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        .join(staying, ["h", "share"], "left")
        .select("h", "id", "keep", "n", F.unhex(F.sha2("t", 256)).alias("sha"), (F.col("t") == F.col("stays")).alias("same"),
                F.when(F.col("t") != F.col("stays"), F.col("t")).alias("own")), "exact-compared")

    odd = compared.filter(~F.col("same"))
    odd_sizes = odd.groupBy("h").agg(F.count(F.lit(1)).alias("odd"))
    own = odd.groupBy("h", "own").agg(F.count(F.lit(1)).alias("size"), best("id").alias("own_keep"))
    single = groups.filter("n = 1").select(F.col("keep").alias("id"), "keep", F.col("n").alias("size"), "sha")
    same = (compared.filter("same").join(odd_sizes, "h", "left")
            .select("id", "keep", (F.col("n") - F.coalesce("odd", F.lit(0))).alias("size"), "sha"))
    different = odd.join(own, ["h", "own"]).select("id", F.col("own_keep").alias("keep"), "size", "sha")
    return single.unionByName(same).unionByName(different).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
