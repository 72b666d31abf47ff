"""Reproducible, exact splits.

Every random choice is an md5 of ``seed:id`` — independent of partitioning
and equal in any engine.

The stratified split needs, per class, the rows whose key ranks below the
class quota.  A window ``partitionBy(label)`` would put a whole class — one
class may hold a third of all rows — into one task.  Instead the quota-th
smallest key of each class (its *cutoff*) is found by refining key-prefix
histograms: each round is one scan with a map-side-combined count per
(class, next 4 hex digits), leaving only the rows of one bucket per class as
candidates; when the candidates are few, a histogram of the rest of their keys
fixes the cutoff.  Rows are then labelled ``dev`` iff ``key <= cutoff``.  Where
a quota ends among rows with one key (a repeated id), these rows are numbered by
a distributed sort.  Quotas and cutoffs are tables with a row per class, joined
by label: there may be as many classes as rows, and nothing about them is
gathered by the driver.  Nothing is sorted within a class either.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.operators.joins import lookup_join
from lectio.operators.sequence import with_row_number
from lectio.session import cut_lineage

LOG = logging.getLogger("lectio.split")
DEFAULT_SEED = "42"
CANDIDATES = 200_000  # candidate rows whose whole keys the last histogram holds
DIGITS_PER_ROUND = 4


def split_key(id_col, seed: str = DEFAULT_SEED):
    """md5 of ``seed:id``; a null id has a key as well, that of an empty one."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def quotas(counts: list[tuple], test_fraction: float) -> tuple[dict, list]:
    """Dev rows per class of a short list of counts: ``ceil(f·N)`` in total,
    split by largest remainder (ties by label).  Classes with fewer than two
    rows stay in train and are reported."""
    total = sum(n for _, n in counts)
    n_dev = math.ceil(test_fraction * total)
    out, rems, singles = {}, [], []
    for lab, n in counts:
        if n < 2:
            out[lab] = 0
            singles.append(lab)
            continue
        q, r = divmod(n_dev * n, total)
        out[lab] = q
        rems.append((-r, lab))
    left = n_dev - sum(out.values())
    for _, lab in sorted(rems, key=lambda x: (x[0], x[1]))[:max(left, 0)]:
        out[lab] += 1
    return out, singles


def quota_table(counts: DataFrame, test_fraction: float) -> DataFrame:
    """The same for any number of classes: ``(label, need)`` from ``(label,
    n)`` without null labels."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_dev = math.ceil(test_fraction * total)
    product, every = f"CAST(CAST({n_dev} AS DECIMAL(38,0)) * n AS DECIMAL(38,0))", max(total, 1)
    parts = counts.select("label", F.expr(f"IF(n < 2, 0L, {product} DIV {every})").alias("q"),
                          F.expr(f"IF(n < 2, NULL, CAST({product} % {every} AS BIGINT))").alias("rem"))
    parts = cut_lineage(parts)
    left = n_dev - (parts.agg(F.sum("q")).first()[0] or 0)
    ranked = with_row_number(parts.filter("rem IS NOT NULL"), [F.desc("rem"), "label"], "place")
    more = ranked.select("label", (F.col("q") + (F.col("place") <= left).cast("long")).alias("need"))
    return cut_lineage(more.unionByName(parts.filter("rem IS NULL").select("label", F.col("q").alias("need"))))


def _cutoffs(keyed: DataFrame, need: DataFrame, total: int, candidates: int) -> DataFrame:
    """``(label, cutoff, take, there)``: the ``need``-th smallest ``key`` of
    each class, how many rows with that key to take, and how many there are.

    ``keyed``: ``(label, key)``; ``total``: its rows; ``need``: ``(label,
    need)``, positive."""
    state = need.select("label", F.lit("").alias("prefix"), "need")
    depth, left = 0, total
    while True:
        prefix = F.substring("key", 1, depth) if depth else F.lit("")
        cand = lookup_join(keyed.withColumn("prefix", prefix), state, ["label", "prefix"], "inner")
        step = min(DIGITS_PER_ROUND, 32 - depth) if left > candidates else 32 - depth
        # rows per next digits; the whole rest of the key once candidates are few
        hist = (cand.withColumn("bucket", F.substring("key", depth + 1, step))
                .groupBy("label", "prefix", "need", "bucket").agg(F.count(F.lit(1)).alias("n")))
        w = Window.partitionBy("label").orderBy("bucket")  # the buckets of a class, not its rows
        hist = hist.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.col("cum") - F.col("n")
        chosen = cut_lineage(hist.filter((before < F.col("need")) & (F.col("need") <= F.col("cum")))
                             .select("label", F.concat("prefix", "bucket").alias("prefix"),
                                     (F.col("need") - before).alias("need"), "n"))
        depth, left = depth + step, chosen.agg(F.sum("n")).first()[0] or 0
        if depth >= 32:
            return chosen.toDF("label", "cutoff", "take", "there")
        state = chosen.drop("n")


def _places(ties: DataFrame, label_col: str) -> DataFrame:
    """``_place``, from 1, of every row among those of its label: the rows are
    written with their position, sorted by label and position over many tasks,
    and each label's first number is taken off."""
    from lectio.session import scratch_path

    path = scratch_path(ties.sparkSession, "split-ties")
    ties.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    numbered = with_row_number(ties.sparkSession.read.parquet(path), [label_col, "_at"], "_number")
    first = numbered.groupBy(label_col).agg(F.min("_number").alias("_first"))
    placed = lookup_join(numbered, first, label_col, "inner")
    return placed.withColumn("_place", F.col("_number") - F.col("_first") + 1).drop("_at", "_number", "_first")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_fraction: float = 0.15,
                     seed: str = DEFAULT_SEED, split_col: str = "split",
                     candidates: int = CANDIDATES) -> DataFrame:
    """M1: exact stratified split; adds ``split`` = ``train`` | ``dev``.

    Rows without a label belong to no class: their ``split`` is null, and
    their number is logged.  Rows that repeat an id are told apart only where
    the quota ends among them, so it is met exactly."""
    columns = [c for c in df.columns if c != split_col]
    counts = cut_lineage(class_counts(df.select(F.col(label_col).alias("label")), "label"))
    missing = counts.filter("label IS NULL").agg(F.sum("n")).first()[0]
    if missing:
        LOG.warning("stratified split: %d rows without a label are in neither part", missing)
    counts = counts.filter("label IS NOT NULL")
    singles = counts.filter("n < 2").count()
    if singles:
        LOG.warning("stratified split: %d classes with one row stay in train", singles)
    need = quota_table(counts, test_fraction).filter("need > 0").select("label", "need")
    keyed = df.select(F.col(label_col).alias("label"), split_key(id_col, seed).alias("key")).filter("label IS NOT NULL")
    total = counts.agg(F.sum("n")).first()[0] or 0
    cut = _cutoffs(cut_lineage(keyed), need, total, candidates)
    cut = cut.select(F.col("label").alias("_lab"), F.col("cutoff").alias("_cutoff"), F.col("take").alias("_take"),
                     F.col("there").alias("_there"))
    rows = df.select(*columns).withColumns({"_key": split_key(id_col, seed), "_lab": F.col(label_col)})
    out = lookup_join(rows, cut, "_lab", "left")
    dev = F.coalesce(F.col("_key") <= F.col("_cutoff"), F.lit(False))

    def marked(rows: DataFrame, is_dev) -> DataFrame:
        value = F.when(is_dev, "dev").otherwise("train")
        return rows.withColumn(split_col, F.when(F.col(label_col).isNotNull(), value)).select(*columns, split_col)

    if cut.filter("_take < _there").isEmpty():
        return marked(out, dev)
    # some class's quota ends among rows with one id: number those rows
    tied = F.coalesce((F.col("_key") == F.col("_cutoff")) & (F.col("_take") < F.col("_there")), F.lit(False))
    ties = _places(out.filter(tied), "_lab")
    return marked(out.filter(~tied), dev).unionByName(marked(ties, F.col("_place") <= F.col("_take")))


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: str = DEFAULT_SEED, fold_col: str = "fold") -> DataFrame:
    """M3: fold = first 32 bits of md5(seed:id) mod k."""
    h = F.conv(F.substring(split_key(id_col, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(fold_col, F.pmod(h, F.lit(k)).cast("int"))


def augmented_split(original: DataFrame, added: DataFrame, id_col: str, label_col: str,
                    test_fraction: float = 0.15, seed: str = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """M2: ``original`` keeps its own ``split``; only ``added`` is split
    (stratified); the two are appended."""
    return original.unionByName(stratified_split(added, id_col, label_col, test_fraction, seed, split_col))


def shuffle_positions(df: DataFrame, id_col: str, seed: str = DEFAULT_SEED, pos_col: str = "shuffle_pos") -> DataFrame:
    """O1: a full seeded shuffle, materialised as 1-based positions in md5
    order (range-partitioned sort, distributed numbering)."""
    return with_row_number(df.withColumn("_k", split_key(id_col, seed)), ["_k", id_col], pos_col).drop("_k")


def shuffled_head(df: DataFrame, id_col: str, n: int = 5, seed: str = DEFAULT_SEED) -> DataFrame:
    """O2: the first ``n`` rows of the seeded shuffle (a bounded top-n)."""
    return df.withColumn("_k", split_key(id_col, seed)).orderBy("_k", id_col).limit(n).drop("_k")
