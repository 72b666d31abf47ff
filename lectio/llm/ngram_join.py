"""N-gram Jaccard join with signature trees.

A document's set holds its distinct 5-word shingles; two documents link when
100 * |shared| >= 75 * |union|.  The join is exact.

*Blocks.*  Sets that reach the threshold share one of their first
``n - ceil(0.75 n) + 1`` shingles under any common order (prefix filter), so
documents meet in the blocks of those shingles.  The order puts common shingles
last: every document's shingles are counted, in slots by their hash, and sorted by
their slot's count.  The order bears on the size of blocks only, never on the result.

*Signature trees.*  Within a block, documents are the leaves of a tree, by
size; a leaf holds a bitmap of its shingles and its size, and an inner node
the OR of its children's bitmaps and the range of their sizes.  Two trees are
traversed together: a pair of nodes is left as soon as the sizes, or the
largest overlap that the bitmaps allow, rule the threshold out.  Leaf pairs
that remain are compared exactly.

*Rounds.*  First every block compares its documents with the most widely
shared one among them, which links a group of near copies with as many
comparisons as it has members.  In the next rounds, while a good part of the
pairs link, every document of a block
that still holds several components is compared with its likeliest partner in
another component, as in a spanning forest; where pairs are few, with all.
A block whose pairs were all compared is done; the
last round compares all pairs of different components that the trees leave in
the others, of which few are then left; so the components are exact, and no
block emits all its pairs.  Trees
are traversed on signatures alone; texts travel only for the exact comparison
of the pairs that remain.

Equal word sequences are one document throughout.  Large blocks are split: a
centre's members are dealt over shares, a block over size classes and then over
pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.common import free_memory, stage, text_or_empty
from lectio.llm.components import components, joined
from lectio.llm.substring import _by_slices
from lectio.llm.wordhash import batch_hashes, mix, run_hashes, span_hashes
from lectio.operators.joins import sized_broadcast

WORDS = 5
#: Threshold as 100 * shared >= PERCENT * union.
PERCENT = 75
#: Slots in which shingles are counted, a power of two, and in how many blocks
#: a task's counts travel.
SLOTS, SLOT_BLOCKS = 1 << 22, 64
#: Members that one share of a centre compares; documents of one tree.
SHARE = 256
#: Rounds that compare a document with its likeliest partner only, at most;
#: and the share of linked ones among their pairs (one over it) below which
#: they end: what is left then hardly links, and is compared once.
PARTNER_ROUNDS, LINKED_SHARE = 3, 20
#: Pairs for each of its documents up to which a group compares all at once.
FEW_PAIRS = 2
#: Bits of a signature: a power of two, at least four for each shingle,
#: within these bounds.
LEAST_BITS, MOST_BITS = 512, 1 << 16
FAN = 8
#: Documents of pairs up to which a list of them goes to every task.
FEW_IDS = 1 << 18


# -- sets ---------------------------------------------------------------------
def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by a plain sort, which takes a sixth of its hash table's time."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased).  A text
    with fewer words has one shingle, all of them; without words, none."""
    h, ends = batch_hashes([t.lower() for t in texts])
    runs = run_hashes(h, words)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= words:
            out.append(_distinct(runs[start:end - words + 1]))
        elif end > start:
            whole = span_hashes(h, np.array([start]), np.array([end]))
            out.append(mix(whole ^ np.uint64(end - start)))
        else:
            out.append(np.empty(0, np.uint64))
        start = end
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


# -- signature trees ----------------------------------------------------------
def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set's shingles, by their low bits."""
    bits = min(max(1 << (4 * len(s) - 1).bit_length(), LEAST_BITS), MOST_BITS) if len(s) else LEAST_BITS
    bitmap = np.zeros(bits, bool)
    bitmap[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(bitmap).tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, all folded to the shortest."""
    width = min(map(len, signatures))
    rows = [np.bitwise_or.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0) for s in signatures]
    return np.stack(rows).view(np.uint64)


class SignatureTree:
    """Levels of OR-combined bitmaps and size ranges over documents, by size.
    ``maps`` are their folded signatures, ``size`` their numbers of
    shingles."""

    def __init__(self, maps: np.ndarray, size: np.ndarray, fan: int = FAN):
        self.order = np.argsort(size, kind="stable")
        packed, size = maps[self.order], np.asarray(size)[self.order]
        #: shingles that fell on a bit already set
        excess = size - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        self.fan, self.levels = fan, [(packed, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes one level down: (which node, child)."""
        below = len(self.levels[level - 1][1])
        count = np.minimum((node + 1) * self.fan, below) - node * self.fan
        which = np.repeat(np.arange(len(node)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, node[which] * self.fan + step


def possible(a, i: np.ndarray, b, j: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs may hold a linked pair, and the largest overlap of
    those that may."""
    maps_a, low_a, high_a, excess_a = a
    maps_b, low_b, high_b, excess_b = b
    fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    keep = np.flatnonzero(fits)
    i, j = i[keep], j[keep]
    overlap = np.bitwise_count(maps_a[i] & maps_b[j]).sum(axis=1, dtype=np.int64)
    overlap += np.minimum(excess_a[i], excess_b[j])  # shared shingles on one bit
    overlap = np.minimum(overlap, np.minimum(high_a[i], high_b[j]))
    enough = (100 + percent) * overlap >= percent * (low_a[i] + low_b[j])
    return keep[enough], overlap[enough]


def leaf_pairs(a: SignatureTree, b: SignatureTree, percent: int = PERCENT):
    """Traverse two trees together; yields the leaf pairs that remain: places
    (in the trees' sets) and the highest Jaccard that the signatures allow.
    The same tree twice gives each pair once."""
    same = a is b
    # node pairs compared at once: 16 MB of their bitmaps
    chunk = min(1 << 14, max(256, (1 << 21) // a.levels[0][0].shape[1]))
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(la, lb, i[k:k + chunk], j[k:k + chunk]) for k in range(0, len(i), chunk)]
            continue
        keep, overlap = possible(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[keep], j[keep]
        if la == 0 and lb == 0 and same:
            own = i < j
            i, j, overlap = i[own], j[own], overlap[own]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            either = a.levels[0][1][i] + b.levels[0][1][j]
            yield a.order[i], b.order[j], overlap / np.maximum(either - overlap, 1)
            continue
        down_a = la > 0 and (same or la >= lb)
        down_b = lb > 0 and (same or not down_a)
        if down_a:
            which, i = a.children(la, i)
            j = j[which]
        if down_b:
            which, j = b.children(lb, j)
            i = i[which]
        la, lb = la - down_a, lb - down_b
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
        stack.append((la, lb, i, j))


# -- the join -------------------------------------------------------------------
def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _set_table(src: DataFrame, words: int, percent: int, common: np.ndarray,
               counts: np.ndarray | None = None) -> DataFrame:
    """id, set size, 128 bits of the folded word sequence, signature and
    prefix: the set's first shingles in the common order."""

    def run(it):
        for rows in _by_slices(it):
            texts = [t.encode() for _, t in rows]
            keys = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            sets = shingle_sets(texts, words)
            first = [_prefix(s, percent, common, counts) for s in sets]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(map(signature, sets), pa.binary()), prefix],
                ["id", "n", "k1", "k2", "sig", "prefix"])

    return src.mapInArrow(run, T.StructType([*_long("id", "n", "k1", "k2"), T.StructField("sig", T.BinaryType()),
                                             T.StructField("prefix", T.ArrayType(T.LongType()))]))


def _slots(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(src: DataFrame, words: int) -> np.ndarray:
    """How often each slot's shingles occur in the sets of all documents."""
    width = SLOTS // SLOT_BLOCKS

    def packed(counts: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint32).tobytes())

    def opened(z: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint32)

    def count(it):
        counts = np.zeros(SLOTS, np.int64)
        for rows in _by_slices(it):
            sets = shingle_sets([t.encode() for _, t in rows], words)
            counts += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
        blocks = counts.reshape(SLOT_BLOCKS, width)
        for block in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed(blocks[block])])], ["block", "z"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for block, z in zip(*(c.to_pylist() for c in b.columns)):
                sums[block] = sums.get(block, 0) + opened(z).astype(np.int64)
        for block, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed(counts)])], ["block", "z"])

    schema = T.StructType([*_long("block"), T.StructField("z", T.BinaryType())])
    counts = np.zeros((SLOT_BLOCKS, width), np.uint32)
    for block, z in src.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        counts[block] = opened(bytes(z))
    return counts.reshape(-1)


def _prefix(s: np.ndarray, percent: int, common: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The shingles of which a linked set has one, by their slots' ``counts``,
    ``common`` ones last."""
    length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
    if counts is not None:
        s = s[np.argsort(counts[_slots(s)], kind="stable")]
    if len(s) and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        last = common[at] == s
        s = np.concatenate([s[~last], s[last]])
    return s[:length]


def _compressed(src: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and compressed text; of few pairs only their documents."""
    ids = pairs.select(F.explode(F.array("centre", "id")).alias("id")).distinct()
    few = sized_broadcast(ids, FEW_IDS)
    if few is not None:
        src = src.join(few, "id", "left_semi")

    def run(it):
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            data = [z.compress(t.as_py().encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "z"])

    return src.mapInArrow(run, T.StructType([*_long("id"), T.StructField("z", T.BinaryType())]))


def _cells(c: pa.Array) -> list:
    """A column's values; lists of numbers (none is null) as views of them."""
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    values, ends = c.values.to_numpy(), c.offsets.to_pylist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _streamed_groups(it, cells=pa.Array.to_pylist):
    """Rows of batches that are sorted by their first column, group by group."""
    key, rows = None, []
    for b in it:
        for row in zip(*map(cells, b.columns)):
            if rows and row[0] != key:
                yield rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield rows
        rows = []
    free_memory()


def _pair_batches(found, names):
    buf = []
    for pair in found:
        buf.append(pair)
        if len(buf) >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*buf)], names)
            buf = []
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*buf)], names)


def _runs(rows: list, key):
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or key(rows[i]) != key(rows[start]):
            yield rows[start:i]
            start = i


def _dealt(pairs: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """(centre, id) pairs as groups of rows, a centre and a share of its
    members each, the centre first: g, centre, share, id and the columns of
    ``docs``.  Every share has its copy of the centre."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    members = (pairs.join(sizes, "centre")
               .select("centre", "id", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")))
    heads = sizes.select("centre", F.col("centre").alias("id"),
                         F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rows = members.unionByName(heads).join(docs, "id")
    rows = rows.select(F.xxhash64("centre", "share").alias("g"), "centre", "share", "id",
                       *[c for c in docs.columns if c != "id"])
    return rows.repartition("centre", "share").sortWithinPartitions(
        "g", "centre", "share", F.col("id") != F.col("centre"))


def _shares(it, cells=pa.Array.to_pylist):
    for rows in _streamed_groups(it, cells):
        for part in _runs(rows, lambda r: (r[1], r[2])):
            if len(part) > 1:
                yield part


def _centre_candidates(pairs: DataFrame, sigs: DataFrame, percent: int, share: int) -> DataFrame:
    """The (centre, id) pairs that the members' trees leave."""

    def run(it):
        def found():
            for part in _shares(it):
                maps, size = folded([r[5] for r in part]), np.array([r[4] for r in part])
                centre, tree = SignatureTree(maps[:1], size[:1]), SignatureTree(maps[1:], size[1:])
                for _, j, _ in leaf_pairs(centre, tree, percent):
                    yield from ((part[0][1], part[k + 1][3]) for k in j.tolist())

        yield from _pair_batches(found(), ["centre", "id"])

    return _dealt(pairs, sigs, share).mapInArrow(run, T.StructType(_long("centre", "id")))


def _links(pairs: DataFrame, packed: DataFrame, words: int, percent: int, share: int) -> DataFrame:
    """The linked ones of (centre, id) pairs, compared exactly."""

    def run(it):
        z = zstandard.ZstdDecompressor()

        def found():
            for part in _shares(it):
                sets = shingle_sets([z.decompress(r[4]) for r in part], words)
                yield from ((part[0][1], r[3]) for r, s in zip(part[1:], sets[1:]) if linked(sets[0], s, percent))

        yield from _pair_batches(found(), ["a", "b"])

    return _dealt(pairs, packed, share).mapInArrow(run, T.StructType(_long("a", "b")))


def _best_partners(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some pairs, those that are the likeliest of either member (of
    equals, the first partner)."""
    doc, partner = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((partner, -np.concatenate([likeness, likeness]), doc))
    doc, partner = doc[order], partner[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)])
    return doc[first], partner[first]


def _kept_best(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> list[np.ndarray]:
    """The pairs among which every member's likeliest is."""
    doc, partner = _best_partners(i, j, likeness)
    order = {pair: n for n, pair in enumerate(zip(i.tolist(), j.tolist()))}
    at = [order[p] if p in order else order[p[::-1]] for p in zip(doc.tolist(), partner.tolist())]
    at = np.unique(np.array(at, np.int64))
    return [i[at], j[at], likeness[at]]


def _ordered(a: np.ndarray, b: np.ndarray):
    return zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())


def _block_candidates(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different components that the trees of each group leave; with
    ``best``, of a group with many, only each document's likeliest, and a row
    with only ``g`` if it has others.  ``rows``: g (group), id, component, part, n, sig.
    A group of one part is traversed with itself, a group of two across."""
    dealt = rows.select("g", "id", "component", "part", "n", "sig").repartition("g").sortWithinPartitions("g", "part", "id")

    def run(it):
        def found():
            for rows in _streamed_groups(it):
                maps, size = folded([r[5] for r in rows]), np.array([r[4] for r in rows])
                cut = sum(r[3] == rows[0][3] for r in rows)
                tree = SignatureTree(maps[:cut], size[:cut])
                across = cut < len(rows)
                other = SignatureTree(maps[cut:], size[cut:]) if across else tree
                ids, component = (np.array([r[c] for r in rows]) for c in (1, 2))
                left, seen = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], 0
                for i, j, likeness in leaf_pairs(tree, other, percent):
                    j = j + cut if across else j
                    keep = component[i] != component[j]
                    pairs = i[keep], j[keep], likeness[keep]
                    seen += len(pairs[0])
                    if best:  # of what came so far, so that little is held
                        left = [np.concatenate(c) for c in zip(left, pairs)]
                        if len(left[0]) > 1 << 20:
                            left = _kept_best(*left)
                    else:
                        yield from ((a, b, None) for a, b in _ordered(ids[pairs[0]], ids[pairs[1]]))
                if best and seen:
                    few = len(left[0]) == seen <= FEW_PAIRS * len(rows)
                    i, j, _ = left if few else _kept_best(*left)
                    yield from ((a, b, None) for a, b in _ordered(ids[i], ids[j]))
                    if seen > len(i):
                        yield None, None, rows[0][0]

        yield from _pair_batches(found(), ["centre", "id", "g"])

    return dealt.mapInArrow(run, T.StructType(_long("centre", "id", "g")))


def _open_groups(blocks: DataFrame, labels: DataFrame, percent: int, share: int,
                 rest: DataFrame | None = None) -> DataFrame:
    """g, id, component, part: the documents of blocks that hold several
    components, by size class, large blocks as pairs of parts; of ``rest``
    only its groups.  Blocks of two
    documents met in the first round; blocks of the same documents are
    compared once."""
    known = blocks.filter("c > 2").join(labels, "id", "left").select(
        "t", "id", "n", F.coalesce("component", "id").alias("component"))
    step = F.lit(float(np.log(100 / percent)))
    size_class = F.floor(F.log("n") / step + F.lit(1e-9)).cast("int")
    known = known.withColumn("size_class", F.explode(F.array(size_class, size_class + 1)))
    several = (known.groupBy("t", "size_class")
               .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"),
                    F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
               .filter("lo < hi"))
    chosen = several.groupBy("c", "x", "y").agg(F.min(F.struct("t", "size_class")).alias("s"))
    chosen = stage(chosen.select("s.t", "s.size_class", F.ceil(F.col("c") / (2 * share)).cast("int").alias("parts")),
                   "jaccard-open")

    def group(x: str, y: str):
        return F.xxhash64("t", "size_class", F.least(x, y), F.greatest(x, y)).alias("g")

    if rest is not None:  # only the classes with such a group meet their documents again
        parts = F.sequence(F.lit(0), F.col("parts") - 1)
        pairs = chosen.withColumn("x", F.explode(parts)).withColumn("y", F.explode(F.sequence("x", F.col("parts") - 1)))
        chosen = pairs.select("t", "size_class", "parts", group("x", "y")).join(rest, "g", "left_semi").drop("g").distinct()
    left = known.join(chosen, ["t", "size_class"])
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select(group("part", "other"), "id", "component", "part")
    return left if rest is None else left.join(rest, "g", "left_semi")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, share: int = SHARE,
                       sample_docs: int | None = None, common: int | None = None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (the
    smallest id that links reach, itself included).

    Null and empty texts have no shingles and link with nothing.  Rows with a
    null id are carried with a null component.  Rows that repeat an id are one
    document of the first component among them.  Other columns are not read.
    ``sample_docs`` and ``common`` have no effect: all shingles of all documents
    are counted.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    known = src.filter("id IS NOT NULL")
    counts = _slot_counts(known, words)
    # read by the blocks, the classes and the result: sets are made once
    table = stage(_set_table(src, words, percent, np.empty(0, np.uint64), counts), "jaccard-sets")
    src = known
    own = table.filter("id IS NOT NULL AND n > 0")
    classes = own.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    reps = classes.select(F.col("rep").alias("id"), "n").distinct()
    sigs = own.select("id", "k1", "k2", "n", "sig").join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"])
    sigs = stage(sigs.select("id", "n", "sig"), "jaccard-signatures")

    # blocks: shingles that two documents or more have in their prefixes
    here = F.count(F.lit(1)).over(Window.partitionBy("t"))
    prefixes = own.select(F.explode("prefix").alias("t"), "id")
    shared = prefixes.withColumn("c", here).filter("c > 1").drop("c")
    rows = stage(shared.join(reps, "id").select("t", "id", "n"), "jaccard-rows")
    counted = rows.withColumn("c", here).filter("c > 1")
    fame = F.avg("c").over(Window.partitionBy("id"))
    blocks = stage(counted.withColumn("fame", fame), "jaccard-blocks")  # t, id, n, c, fame

    # first round: every block's documents with its most widely shared one
    centres = blocks.groupBy("t").agg(F.max(F.struct("fame", F.col("id").alias("centre"), F.col("n").alias("m"))).alias("s"))
    pairs = (blocks.join(centres, "t").filter("id <> s.centre")
             .filter(f"100 * least(n, s.m) >= {percent} * greatest(n, s.m)")
             .select(F.col("s.centre").alias("centre"), "id").distinct())
    pairs = stage(_centre_candidates(stage(pairs, "jaccard-pairs"), sigs, percent, share), "jaccard-candidates")
    links = stage(_links(pairs, _compressed(src, pairs), words, percent, share), "jaccard-links")

    # further rounds: blocks that still hold several components
    labels, rounds, last, rest = components(links), 0, False, None
    while True:
        groups = _open_groups(blocks, labels, percent, share, rest)  # the pairs of all other groups were compared
        more = stage(_block_candidates(groups.join(sigs, "id"), percent, not last).distinct(), "jaccard-candidates")
        rest, more = more.filter("g IS NOT NULL").select("g"), more.filter("g IS NULL").select("centre", "id")
        compared = more.count()
        more = stage(_links(more, _compressed(src, more), words, percent, share), "jaccard-links")
        found = more.count()
        if found:
            labels = joined(labels, more)
        if last:
            break
        rounds += 1
        last = found * LINKED_SHARE <= compared or rounds == PARTNER_ROUNDS
    labelled = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    result = table.join(labelled, ["k1", "k2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return result
