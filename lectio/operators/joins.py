"""Lookup joins with a checked broadcast and a skew-safe fallback.

Every lookup in the reference is a dict ``get`` on a small table (lexicon,
morphological analyses, code maps).  In Spark that is a broadcast hash join,
but only when the small side is *proven* small: its rows and bytes are counted
(a partial aggregate, one row per task), never assumed.

Beyond the bound the fallback is a shuffle join made safe for hot keys: the
most frequent keys of the large side (at most ``hot_keys``, and no more lookup
rows than may be broadcast) are estimated from a seeded sample, their lookup
rows are broadcast, and only the remaining, cold keys go through the shuffle.
Words of a text are few beyond the first hundreds of thousands, so little is
shuffled.  The sample only decides which path a key takes; every row is joined,
so results are exact whatever the sample holds, and keys frequent enough to
unbalance a task are caught by it.  The frequent keys are found by a threshold
on their counts, and stay a table: the driver gets the histogram of the counts.

Cold words that a lexicon lacks never reach that shuffle: a bitmap of the
lexicon's hashed keys (a fixed number of bits, whatever the lexicon's size) is
broadcast, and a row whose bit is clear surely has no partner.  A row whose bit
is set by another key is only shuffled in vain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.session import stored_rows

DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20
DEFAULT_HOT_KEYS = 1_000_000
DEFAULT_HOT_SAMPLE = 0.1
#: Bits of the bitmap of keys: 2 MB, as at most 262,144 rows of a word each.
DEFAULT_BITMAP_BITS = 1 << 24


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        return int(df.sparkSession.conf.get(key, str(default)))
    except Exception:  # pragma: no cover - conf access is best effort
        return default


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and about how many bytes they hold: strings and binaries by their
    length, anything else 16 bytes a column.  Every task sends one row of
    sums, so nothing is gathered however large ``df`` is."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + 16 * (F.greatest(F.size(c), F.lit(0)) + 1)
        else:
            size = size + 16
    row = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return row[0], row[1] or 0


def sized_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame | None:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows of at most
    ``max_bytes`` together, else None."""
    rows = max_rows or _conf_int(df, "lectio.broadcast.maxRows", DEFAULT_BROADCAST_ROWS)
    size = max_bytes or _conf_int(df, "lectio.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES)
    n, b = measured(df)
    return F.broadcast(df) if n <= rows and b <= size else None


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left",
                max_rows: int | None = None, hot_keys: int | None = None,
                skew_safe: bool = True, probe: DataFrame | None = None) -> DataFrame:
    """Join a large ``left`` to a keyed lookup table ``right``.

    ``right`` must hold one row per key (a dictionary).  ``how`` is
    ``left``, ``inner``, ``left_semi`` or ``left_anti``.  ``skew_safe=False``
    (for keys unique on the left, e.g. document ids) leaves the large case
    to Catalyst/AQE's shuffle join.  ``probe``: a sample of ``left``'s keys, where
    one is cheaper to get (:func:`hot_sample`) than by sampling ``left``.
    """
    small = sized_broadcast(right, max_rows)
    if small is not None:
        return left.join(small, on, how)
    if not skew_safe:
        return left.join(right, on, how)
    # read for the bitmap, the hot keys and the shuffle: computed once
    return hot_split_join(left, stored_rows(right, "lookup"), on, how, hot_keys, probe=probe)


def hot_sample(df: DataFrame, fraction: float | None = None) -> DataFrame:
    """The seeded sample from which frequent keys are estimated."""
    if fraction is None:
        fraction = float(df.sparkSession.conf.get("lectio.join.hotSampleFraction", str(DEFAULT_HOT_SAMPLE)))
    return df.sample(fraction=fraction, seed=42) if fraction < 1.0 else df


def frequent_keys(probe: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` keys of ``probe``: those above a count that the
    histogram of all counts gives.  There are as many different counts as the
    root of twice the rows of ``probe`` at most."""
    counts = stored_rows(probe.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    least, total = None, 0
    for n, number in sorted(((r["_n"], r["count"]) for r in counts.groupBy("_n").count().collect()), reverse=True):
        total += number
        if total > most:
            break
        least = n
    return counts.filter(F.lit(False) if least is None else F.col("_n") >= least).select(*keys)


def key_bitmap(right: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``(_word, _bits)``: the set bits of the keys' hashes, 64 to a row."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = right.select((F.shiftright(place, 6)).alias("_word"), place.alias("_at"))
    one = F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")
    return words.groupBy("_word").agg(F.bit_or(one).alias("_bits"))


def mark_absent(left: DataFrame, right: DataFrame, keys: list[str], bits: int, where: Column | None = None) -> DataFrame:
    """``left`` with ``_absent``: true where ``right`` surely lacks the key (a
    null key is absent), false where it may hold it.  Rows outside ``where``
    are not looked up; theirs is null."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    probed = left.withColumn("_at", place if where is None else F.when(where, place))
    probed = probed.withColumn("_word", F.shiftright("_at", 6))
    probed = probed.join(F.broadcast(key_bitmap(right, keys, bits)), "_word", "left")
    clear = F.expr("COALESCE(_bits, 0L) & shiftleft(1L, CAST(_at & 63 AS INT))") == 0
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return probed.withColumn("_absent", null | clear).drop("_word", "_at", "_bits")


def hot_split_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left",
                   hot_keys: int | None = None, sample: float | None = None,
                   probe: DataFrame | None = None) -> DataFrame:
    """Exact shuffle join; rows with a frequent key and rows whose key
    ``right`` surely lacks bypass the shuffle."""
    keys = [on] if isinstance(on, str) else list(on)
    n, size = measured(right)
    limit = _conf_int(left, "lectio.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES)
    most = min(hot_keys or _conf_int(left, "lectio.join.hotKeys", DEFAULT_HOT_KEYS), max(limit * n // max(size, 1), 1))
    probe = hot_sample(left, sample) if probe is None else probe
    hot = frequent_keys(probe.select(*keys), keys, most)
    # at most ``most`` rows, fixed once: both uses below must see the same set
    known = right.join(F.broadcast(hot), keys).withColumn("_known", F.lit(True))
    table = stored_rows(hot.join(known, keys, "left").withColumn("_hot", F.lit(True)), "hot-rows")
    marked = left.join(F.broadcast(table), keys, "left")
    cold = F.col("_hot").isNull()
    bits = _conf_int(left, "lectio.join.bitmapBits", DEFAULT_BITMAP_BITS)
    if bits:
        marked = mark_absent(marked, right, keys, bits, cold)
    else:
        marked = marked.withColumn("_absent", reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))
    # an absent key meets nothing among the hot rows either: no partner
    aside = marked.filter(~cold | F.col("_absent"))
    if how in ("inner", "left_semi"):
        aside = aside.filter("_known")
    elif how == "left_anti":
        aside = aside.filter("_known IS NULL")
    own = [*keys, *[c for c in left.columns if c not in keys]]
    found = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    rest = marked.filter(cold & ~F.col("_absent")).select(*own).join(right, keys, how)
    return aside.select(*own, *found).unionByName(rest.select(*own, *found))


def positional_align(left: DataFrame, right: DataFrame, left_order: list[str] | None = None,
                     right_order: list[str] | None = None) -> DataFrame:
    """Pair the i-th row of ``left`` with the i-th row of ``right``
    (``None`` order: current physical order).

    Both sides are numbered by a distributed sequential id (no single-task
    window); the row counts must agree, as in the reference's guard.
    """
    from lectio.operators.sequence import with_row_number

    a = with_row_number(left, left_order, "_row")
    b = with_row_number(right, right_order, "_row")
    na, nb = left.count(), right.count()
    if na != nb:
        raise ValueError(f"positional alignment needs equal row counts, got {na} and {nb}")
    return a.join(b, "_row", "inner").drop("_row")


def pairing_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """J4 guard as one row: ids on both sides, on the left only and on the
    right only (ids are unique on each side)."""
    a = left.select(on).withColumn("_l", F.lit(1))
    b = right.select(on).withColumn("_r", F.lit(1))
    both = a.join(b, on, "full")

    def count(cond):
        return F.count(F.when(cond, 1))

    has_l, has_r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return both.agg(count(has_l & has_r).alias("matched"), count(has_l & ~has_r).alias("left_only"),
                    count(has_r & ~has_l).alias("right_only"))


def unmatched_count(left: DataFrame, right: DataFrame, on: str) -> int:
    """J4 guard: ids of ``left`` with no partner in ``right``."""
    return left.join(right.select(on), on, "left_anti").count()
