"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct 2-word shingles; two documents link when
100 * |shared| >= 80 * |union|.  Each set keeps its smallest hash values, its
sketch.  The smallest values of a union are its own bottom-k sketch, and each of
them lies in both sets with the sets' Jaccard as its probability.

*Inverted lists.*  Linked sets share at least ``least_shared`` of their retained
values: by counting where the union fits in a sketch, and in larger ones but for
a probability below 1e-10 a pair, whatever the data (drawing without replacement
from a union whose shared part is known).  So, with the values in any common
order, they share one of the first size - least_shared + 1 of them.  The order is
by how many documents retain a value, over all documents, rarest first: few lists
are long, and values of one document only take their places in it without making
a list.

*Estimates.*  A pair from a list is compared by the union of its two sketches:
shared values among the union's smallest, up to the smaller of the two sketches'
last values.  The same bound rules pairs out; sketches that hold whole sets give
the Jaccard itself.

*Signatures.*  A bitmap of a sketch's values bounds what two sketches share.  After
the first round a document stays in a list only if the bitmaps let it link with a
document of another component there; so sketches travel to lists of likely partners,
not to lists that documents share by chance, of which a larger table has more.

*Rounds.*  First every list compares its documents with the one that is most
widely shared.  Then each document takes part in one list that still holds
several components, and the list's members are joined by the likeliest pairs
between components, as in a spanning forest.  The last round compares all pairs
of different components in lists that still hold several.  Every pair that is
kept is verified on the full sets; so a group of near copies is linked with about
as many comparisons as it has members.

Documents with equal sets are one class throughout.  Texts without words have no
set and link with nothing; null texts count as empty.  Rows with a null id are
carried with a null component and kept; rows that repeat an id are one document
of the smallest component among them.  Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.common import stage, text_or_empty
from lectio.llm.components import components, joined
from lectio.llm.ngram_join import (_cells, _dealt, _links, _ordered, _pair_batches, _runs, _shares, _streamed_groups,
                                   shingle_sets)
from lectio.llm.skew import counted_join
from lectio.llm.substring import _by_slices
from lectio.operators.joins import lookup_join, mark_absent, sized_broadcast

WORDS = 2
#: Threshold as 100 * shared >= PERCENT * union.
PERCENT = 80
#: Values of a sketch.
SKETCH = 128
#: Probability that a linked pair of large sets is taken for less.
MISS = 1e-10
#: Set sizes up to which one bound holds, beyond those where the union fits.
STEPS = (110, 120, 130, 145, 160, 180, 200, 230, 260, 300, 350, 420, 500, 700, 1000, 2000, 5000)
#: Members that one task compares with each other or with a centre.
SHARE = 512
#: Bits of the bitmap of values that several documents retain.
BITMAP_BITS = 1 << 24
#: Bits of a sketch's signature: few values of two sketches fall on one bit by chance.
SIGNATURE_BITS = 512
#: Rounds of spanning forests.
FOREST_ROUNDS = 2


# -- sketches -------------------------------------------------------------------
def tail_bound(n: int | None, percent: int = PERCENT, sketch: int = SKETCH, miss: float = MISS) -> int:
    """The most values that ``sketch`` draws from a union share, but for a
    probability of ``miss``: the union of a set of ``n`` with a linked one, at
    its largest, or one without end (None)."""
    if n is None:
        logs = [math.lgamma(sketch + 1) - math.lgamma(k + 1) - math.lgamma(sketch - k + 1) + k * math.log(percent / 100)
                + (sketch - k) * math.log(1 - percent / 100) for k in range(sketch + 1)]
    else:
        def choose(a, b):
            return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) if 0 <= b <= a else -math.inf
        every = max(n * 100 // percent, sketch)
        shared = -(-percent * every // 100)
        logs = [choose(shared, k) + choose(every - shared, sketch - k) - choose(every, sketch) for k in range(sketch + 1)]
    total, k = 0.0, 0
    while total + math.exp(logs[k]) <= miss:
        total += math.exp(logs[k])
        k += 1
    return k


@lru_cache
def bounds(percent: int) -> tuple[tuple[int | None, int], ...]:
    """(largest set size, values that a linked set shares at least) beyond the
    sizes whose unions fit in a sketch."""
    return tuple((n, tail_bound(n, percent)) for n in (*STEPS, None))


def least_shared(percent: int):
    """The bound as an expression over ``n``: all shared values of a union
    that fits in a sketch, at least those of the set, and not more than large
    unions leave."""
    steps = bounds(percent)
    large = F.when(F.col("n") * 100 <= percent * SKETCH, SKETCH)
    for n, k in steps[:-1]:
        large = large.when(F.col("n") <= n, k)
    return F.least(F.ceil(F.col("n") * percent / 100), large.otherwise(steps[-1][1]))


def signatures(sketches: list[np.ndarray]) -> np.ndarray:
    """One row of bytes for each sketch: the bitmap of its values' low bits."""
    bits = np.zeros((len(sketches), SIGNATURE_BITS), bool)
    at = np.concatenate(sketches).astype(np.uint64) & np.uint64(SIGNATURE_BITS - 1)
    bits[np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]), at.astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def sketched(src: DataFrame, words: int, texts: bool = False) -> DataFrame:
    """id, n, k1 and k2 (128 bits of the set) of every row, with sketch (the
    smallest hash values, sorted) and its signature sig, or with z (the text,
    compressed)."""

    def run(it):
        z = zstandard.ZstdCompressor(level=3)
        for rows in _by_slices(it):
            raw = [t.encode() for _, t in rows]
            sets = shingle_sets(raw, words)
            key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            if texts:
                rest = [pa.array([z.compress(t) for t in raw], pa.binary())]
            else:
                first = [s[:SKETCH] for s in sets]
                rest = [pa.array([s.view(np.int64) for s in first], pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in signatures(first)], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(key[:, 0]), pa.array(key[:, 1]), *rest], schema.names)

    kept = [T.StructField("z", T.BinaryType())] if texts else [
        T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("id", "n", "k1", "k2")], *kept])
    return src.mapInArrow(run, schema)


def union_estimates(sketches: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """The estimated Jaccard of all pairs: shared values over the values of
    the union's sketch.  ``whole`` marks sketches that hold all of a set."""
    m, size = len(sketches), np.array([len(s) for s in sketches])
    _, place, count = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(m), size), count > 1
    held = np.zeros((m, int(several.sum())), np.float32)
    keep = several[place]
    held[row[keep], (np.cumsum(several) - 1)[place[keep]]] = 1
    shared = held @ held.T
    np.fill_diagonal(shared, size)
    # values of each up to the last value of each other; a whole set has no last
    upto = np.repeat(size[:, None], m, axis=1)
    cut = np.flatnonzero(~whole)
    if len(cut):
        last = np.array([sketches[j][-1] for j in cut])
        for i, s in enumerate(sketches):
            upto[i, cut] = np.searchsorted(s, last, side="right")
    return shared / np.maximum(upto + upto.T - shared, 1)


def centre_estimates(centre: np.ndarray, others: list[np.ndarray], whole_centre: bool, whole: np.ndarray) -> np.ndarray:
    """The estimates of :func:`union_estimates` of one sketch with others."""
    size, values = np.array([len(s) for s in others]), np.concatenate(others)
    row = np.repeat(np.arange(len(others)), size)
    at = np.minimum(np.searchsorted(centre, values), len(centre) - 1)
    shared = np.bincount(row[centre[at] == values], minlength=len(others))
    last = values[np.cumsum(size) - 1]
    upto = np.where(whole, len(centre), np.searchsorted(centre, last, side="right"))
    own = size if whole_centre else np.bincount(row[values <= centre[-1]], minlength=len(others))
    return shared / np.maximum(upto + own - shared, 1)


def _kept(estimate: np.ndarray, whole: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked, by their estimate and their smaller and
    larger size.  ``whole`` marks pairs of sketches that hold whole sets."""
    steps = bounds(percent)
    table = np.array([k for _, k in steps]) / SKETCH
    bound = table[np.searchsorted([s for s, _ in steps[:-1]], low)]
    bound = np.where(whole, percent / 100, bound)
    return (estimate >= bound - 1e-6) & (100 * low >= percent * high)


def kept_pairs(estimate: np.ndarray, whole: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs may be linked, by their estimate and their sizes."""
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    return _kept(estimate, whole[:, None] & whole[None, :], low, high, percent)


def possible_pairs(maps: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs the signatures (rows of 64-bit words) allow: all that
    :func:`kept_pairs` keeps, whatever their sketches hold."""
    bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    size = np.minimum(n, SKETCH)
    shared = np.zeros((len(n), len(n)), np.int64)
    for column in maps.T:
        shared += np.bitwise_count(column[:, None] & column[None, :])
    excess = size - bits  # shared values may fall on one bit
    shared = np.minimum(shared + np.minimum(excess[:, None], excess[None, :]), np.minimum(size[:, None], size[None, :]))
    # a union that no sketch holds whole counts a sketch's values at least
    both = _whole(n)[:, None] & _whole(n)[None, :]
    union = np.where(both, n[:, None] + n[None, :] - shared, SKETCH)
    return kept_pairs(shared / np.maximum(union, 1), _whole(n), n, percent)


def spanning_forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of the pairs of a maximum spanning forest over components, the
    heaviest first (Kruskal)."""
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    chosen, left = [], len(root) - 1
    for at in np.argsort(-weight, kind="stable").tolist():
        a, b = find(component[i[at]]), find(component[j[at]])
        if a != b:
            root[a] = b
            chosen.append(at)
            left -= 1
            if not left:
                break
    return np.array(chosen, np.int64)


# -- lists ------------------------------------------------------------------------
def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """t, id, n, c and fame: the listed values of every class that two or more
    classes list, with the length of their lists and each class's mean list
    length."""
    rows = classes.select("id", F.explode("sketch").alias("t"))
    counts = stage(rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "bottomk-counts")
    total = counts.agg(F.sum("df")).first()[0] or 0
    # most values of one document only are left before the shuffle, by a bitmap
    maybe = mark_absent(rows, counts, ["t"], BITMAP_BITS).filter(~F.col("_absent")).drop("_absent")
    shared = counted_join(maybe, counts.withColumn("c", F.col("df")), ["t"], total, "c")
    # single values come first in the order: the rest of the prefix is left for shared ones
    own = Window.partitionBy("id")
    place = F.row_number().over(own.orderBy("df", "t"))
    several = F.count(F.lit(1)).over(own)
    placed = shared.select("t", "id", place.alias("place"), several.alias("several")).join(classes.select("id", "n"), "id")
    listed = placed.filter(F.col("place") - F.col("several") <= 1 - least_shared(percent))
    listed = stage(listed.select("t", "id", "n"), "bottomk-listed")
    counts = stage(listed.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "bottomk-lengths")
    total = counts.agg(F.sum("c")).first()[0] or 0
    rows = counted_join(listed, counts.withColumn("m", F.col("c")), ["t"], total, "m")
    fame = F.avg("c").over(Window.partitionBy("id"))
    return stage(rows.withColumn("fame", fame), "bottomk-lists")


def _whole(n: np.ndarray) -> np.ndarray:
    return n <= SKETCH


def centre_candidates(pairs: DataFrame, sketches: DataFrame, percent: int, share: int) -> DataFrame:
    """The (centre, id) pairs that the estimate leaves."""

    def run(it):
        def found():
            for part in _shares(it, _cells):  # g, centre, share, id, n, sketch
                n = np.array([r[4] for r in part])
                whole, first = _whole(n), [r[5].view(np.uint64) for r in part]
                estimate = centre_estimates(first[0], first[1:], whole[0], whole[1:])
                keep = _kept(estimate, whole[0] & whole[1:], np.minimum(n[0], n[1:]), np.maximum(n[0], n[1:]), percent)
                yield from ((part[0][1], part[k + 1][3]) for k in np.flatnonzero(keep).tolist())

        yield from _pair_batches(found(), ["centre", "id"])

    return _dealt(pairs, _asked(sketches, pairs), share).mapInArrow(run, PAIR)


def _asked(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table's rows whose id is in a pair: found before anything large is
    shuffled, if the ids are few enough to be broadcast."""
    ids = stage(pairs.select("id").union(pairs.select("centre")).distinct(), "bottomk-asked")
    return lookup_join(table, ids, "id", "left_semi", skew_safe=False)


PAIR = T.StructType([T.StructField("centre", T.LongType()), T.StructField("id", T.LongType())])
LISTED = T.StructType([T.StructField(c, T.LongType()) for c in ("t", "at", "id", "own")])


def size_classes(lists: DataFrame, percent: int) -> DataFrame:
    """t, at, id, own: lists cut by set size into classes in two of which each
    document lies, so that sets that may link share one.  Lists of two
    documents were compared in the first round."""
    step = F.lit(math.log(100 / percent))
    own = F.floor(F.log("n") / step + F.lit(1e-9)).cast("int")
    rows = lists.filter("c > 2").select("t", "id", own.alias("own"))
    return rows.select("t", F.explode(F.array("own", F.col("own") + 1)).alias("at"), "id", "own")


def open_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """t, at, id, own, component, size: of lists (t, at, id, own) those that
    hold several components.  Lists of the same documents are compared once."""
    known = rows.join(labels, "id", "left").select("t", "at", "id", "own", F.coalesce("component", "id").alias("component"))
    several = known.groupBy("t", "at").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).filter("lo < hi")
    chosen = several.groupBy("size", "x", "y").agg(F.min(F.struct("t", "at")).alias("s"))
    rows = known.join(chosen.select("s.t", "s.at", "size"), ["t", "at"])
    return rows.select("t", "at", "id", "own", "component", "size")


def _listed(sketches: DataFrame, rows: DataFrame) -> DataFrame:
    ids = stage(rows.select("id").distinct(), "bottomk-asked")
    return lookup_join(sketches, ids, "id", "left_semi", skew_safe=False)


def met_before(marks: list[np.ndarray], t: int) -> np.ndarray:
    """Which pairs share a listed value below ``t``: they meet in its list."""
    below = [m[m < t] for m in marks]
    values, place = np.unique(np.concatenate(below), return_inverse=True)
    held = np.zeros((len(marks), len(values)), np.float32)
    held[np.repeat(np.arange(len(marks)), [len(m) for m in below]), place] = 1
    return held @ held.T > 0


def dealt_parts(rows: DataFrame, share: int) -> DataFrame:
    """g for every row of lists (t, at, id, component): a list of more than
    ``share`` documents is dealt as pairs of its parts.  The documents of its
    largest component are compared with the others only, so parts of them do
    not meet each other, and the copies grow with the others' number."""
    sizes = rows.groupBy("t", "at", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("t", "at").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("m"))
    sizes = sizes.filter("size > m.c")  # lists of one component have no pairs
    half = share // 2
    sizes = sizes.select("t", "at", (F.col("size") <= share).alias("whole"), F.col("m.component").alias("main"),
                         F.ceil(F.col("m.c") / half).cast("int").alias("mains"),
                         F.ceil((F.col("size") - F.col("m.c")) / half).cast("int").alias("others"))
    rows = rows.join(sizes, ["t", "at"])
    # parts of the largest component are numbered after the others'
    own, place = F.col("component") == F.col("main"), F.xxhash64("id")
    part = F.when(own, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    last = F.when(own, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    met = F.when(F.col("whole"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), last))
    rows = rows.withColumn("part", F.when(F.col("whole"), F.lit(-1)).otherwise(part)).withColumn("other", F.explode(met))
    g = F.xxhash64("t", "at", F.least("part", "other"), F.greatest("part", "other")).alias("g")
    return rows.select(g, "t", "at", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                       "id", "own", "component")


def _groups(rows: DataFrame, table: DataFrame, columns: list[str], share: int) -> DataFrame:
    """The rows of lists (t, at, id, own, component) with ``columns`` of their
    documents, dealt by :func:`dealt_parts` and group by group."""
    rows = dealt_parts(rows, share).join(table.select("id", *columns), "id")
    rows = rows.select("g", "t", "at", "low", "high", "id", "own", "component", *columns)
    return rows.repartition("g").sortWithinPartitions("g", "t", "at", "low", "high", "id")


def _streamed_parts(it):
    return (part for same in _streamed_groups(it, _cells) for part in _runs(same, lambda r: r[1:5]))


def likely_rows(rows: DataFrame, classes: DataFrame, percent: int, share: int) -> DataFrame:
    """t, at, id, own: the rows of lists (t, at, id, own, component) whose
    document may link, by the signatures, with one of another component in the
    list.  ``classes``: id, n, sig."""

    def run(it):
        def found():
            for group in _streamed_parts(it):
                ids, own, component, n = (np.array([r[c] for r in group], np.int64) for c in (5, 6, 7, 8))
                maps = np.frombuffer(b"".join([r[9] for r in group]), np.uint64).reshape(len(group), -1)
                keep = (possible_pairs(maps, n, percent) & (component[:, None] != component[None, :])).any(axis=1)
                yield from ((*group[0][1:3], *row) for row in zip(ids[keep].tolist(), own[keep].tolist()))

        yield from _pair_batches(found(), LISTED.names)

    # a document that was dealt to several parts may come from each
    dealt = _groups(rows, classes, ["n", "sig"], share).mapInArrow(run, LISTED).distinct()
    return dealt.select("t", F.col("at").cast("int").alias("at"), "id", F.col("own").cast("int").alias("own"))


def list_candidates(rows: DataFrame, sketches: DataFrame, percent: int, share: int, forest: bool) -> DataFrame:
    """Pairs of different components in lists (t, at, id, own, component): a
    spanning forest of those that the estimate leaves, or all of them, each in
    the first list and size class in which its documents meet.  ``sketches``:
    id, n, sketch and marks (the values that a document lists).  Large lists
    are dealt by :func:`dealt_parts`."""
    dealt = _groups(rows, _listed(sketches, rows), ["n", "sketch", "marks"], share)

    def run(it):
        def found():
            for group in _streamed_parts(it):
                ids, own, component, n = (np.array([r[c] for r in group], np.int64) for c in (5, 6, 7, 8))
                if (component == component[0]).all():
                    continue
                estimate = union_estimates([r[9].view(np.uint64) for r in group], _whole(n))
                keep = kept_pairs(estimate, _whole(n), n, percent)
                if not forest:
                    t, at = group[0][1:3]
                    keep &= np.maximum(own[:, None], own[None, :]) == at
                    keep &= ~met_before([r[10] for r in group], t)
                i, j = np.nonzero(np.triu(keep, 1) & (component[:, None] != component[None, :]))
                if forest and len(i):
                    chosen = spanning_forest(i, j, estimate[i, j], component)
                    i, j = i[chosen], j[chosen]
                yield from _ordered(ids[i], ids[j])

        yield from _pair_batches(found(), ["centre", "id"])

    return dealt.mapInArrow(run, PAIR).distinct()


def _verified(pairs: DataFrame, src: DataFrame, keys: DataFrame, words: int, percent: int, share: int) -> DataFrame:
    """The linked pairs, by their full sets.  ``keys``: the classes with their
    documents' id, k1, k2 and n.  Only the texts of classes in a pair travel:
    they are found by id and then by their set."""
    asked = stage(_asked(keys, pairs), "bottomk-asked")
    names = asked.select(F.col("doc").alias("id")).distinct()
    texts = sketched(lookup_join(src, names, "id", "left_semi", skew_safe=False), words, texts=True)
    found = texts.withColumnRenamed("id", "doc").join(asked, ["doc", "k1", "k2", "n"]).select("id", "z")
    # rows that repeat an id and a set would come more than once
    packed = stage(found, "bottomk-texts").groupBy("id").agg(F.min("z").alias("z"))
    return stage(_links(pairs, packed, words, percent, share), "bottomk-links")


# -- the operator -------------------------------------------------------------------
def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, share: int = SHARE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id (the
    smallest id that links reach, itself included) and kept (it is its own
    component's)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    table = stage(sketched(src, words).withColumn("row", F.monotonically_increasing_id()), "bottomk-sketches")
    some = table.filter("id IS NOT NULL AND n > 0")
    named_src = src.filter("id IS NOT NULL")
    groups = some.groupBy("k1", "k2", "n").agg(F.min("row").alias("row"))
    # a class goes by its first row's number: one id may hold several texts
    groups = stage(groups, "bottomk-classes")
    members = some.select("id", "row", "k1", "k2", "n").join(groups.withColumnRenamed("row", "class"), ["k1", "k2", "n"])
    members = stage(members.select("id", "row", "class"), "bottomk-members")
    # the rows of equal sets are few: the sketches of the others need no shuffle, or one
    equal = members.filter(F.col("row") != F.col("class")).select("row")
    few = sized_broadcast(equal)
    classes = some.join(equal if few is None else few, "row", "left_anti").select(
        F.col("row").alias("id"), F.col("id").alias("doc"), "k1", "k2", "n", "sketch", "sig")
    if few is None:
        classes = stage(classes, "bottomk-classes")
    keys = classes.select("id", "doc", "k1", "k2", "n")
    sketches = classes.select("id", "n", "sketch")
    lists = inverted_lists(sketches, percent)

    # first round: every list's documents with its most widely shared one
    head = F.max(F.struct("fame", F.col("id").alias("centre"), F.col("n").alias("m"))).alias("s")
    heads = lists.groupBy("t", "c").agg(head).select("t", "s", "c")
    total = lists.count()
    pairs = counted_join(lists.select("t", "id", "n"), heads, ["t"], total, "c").filter("id <> s.centre")
    pairs = pairs.filter(f"100 * least(n, s.m) >= {percent} * greatest(n, s.m)")
    pairs = stage(pairs.select(F.col("s.centre").alias("centre"), "id").distinct(), "bottomk-pairs")
    pairs = stage(centre_candidates(pairs, sketches, percent, share), "bottomk-candidates")
    links = _verified(pairs, named_src, keys, words, percent, share)
    labels = components(links)

    rows = open_lists(size_classes(lists, percent), labels).drop("size")
    likely = stage(likely_rows(rows, classes, percent, share), "bottomk-likely")
    ids = likely.select("id").distinct()
    marks = lookup_join(lists.select("id", "t"), ids, "id", "left_semi", skew_safe=False).groupBy("id").agg(F.collect_list("t").alias("marks"))
    marked = stage(_listed(sketches, likely).join(marks, "id"), "bottomk-marked")
    rounds, last = 0, False
    while True:
        rows = open_lists(likely, labels)
        if not last:  # one list for each document, the longest
            best = Window.partitionBy("id").orderBy(F.desc("size"), "t", "at")
            rows = rows.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
        found = stage(list_candidates(rows.drop("size", "nth"), marked, percent, share, not last),
                      "bottomk-candidates")
        more = _verified(found, named_src, keys, words, percent, share)
        new = not more.isEmpty()
        if new:
            labels = joined(labels, more)
        if last:
            break
        rounds += 1
        last = not new or rounds == FOREST_ROUNDS

    # classes to ids: a component's smallest id, over repeated ids as well
    named = members.select("id", "class").join(labels.withColumnRenamed("id", "class"), "class", "left")
    named = named.select("id", F.coalesce("component", "class").alias("component")).distinct()
    named = stage(named, "bottomk-named")
    repeated = named.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    if not repeated.isEmpty():  # an id with texts in several components joins them
        bridges = named.join(repeated.select("id", "a"), "id").select("a", F.col("component").alias("b"))
        bridged = components(bridges).withColumnRenamed("id", "old").withColumnRenamed("component", "new")
        named = named.join(bridged, named["component"] == bridged["old"], "left").select(
            "id", F.coalesce("new", "component").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    size = named.count()
    found = counted_join(named, smallest, ["component"], size, "c").groupBy("id").agg(F.min("first").alias("first"))
    result = table.select("id", "n").join(found, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first", "id"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
