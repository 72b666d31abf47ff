"""A trie of conversation prefixes by ternary search trees.

Every conversation is a sequence of turns; a node of the trie is a distinct
sequence of first turns.  The steps:

1. Turns get their places by a distributed numbering and are dictionary-encoded:
   each distinct (role, text) has one integer, by the rank of its 128-bit hash.
2. Conversations are cut into blocks of at most ``block_turns`` turns, so no row
   grows with the longest one.  Equal blocks after equal prefixes are one
   sequence with a number of members.  A prefix has a 128-bit key, the XOR of
   hashes of its (place, turn) pairs; a block's keys follow from the XOR of
   those before it.
3. The sequences of one block level are dealt over shards by their order.  Each
   shard builds a ternary search tree, the median sequence first and then the
   medians of the halves, which keeps it balanced.  An iterative traversal adds
   up members, leaves and savings.
4. A node is on a shard's boundary if it is a prefix of the neighbouring shard's
   nearest sequence as well.  The shard before counts a shared node's own bytes
   and its place among its parent's children, so partial sums of the shards add
   up, and only boundary nodes are merged.  The sums at the root of a block's
   tree go to the node of the level above at which the block starts; the levels
   are worked from the last to the first.  There is one level unless a
   conversation has more than ``block_turns`` turns.

Null roles and texts count as empty.  Turns are ordered by turn (null first),
then role, then the hash of the turn; equal rows are turns of their own.  Rows
without a conversation id belong to no conversation and are left out.  An empty
table has no nodes.  Other columns are not read.  Identity of turns and
prefixes rests on 128 bits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectio.llm.common import stage
from lectio.llm.ngram_join import _streamed_groups
from lectio.llm.skew import counted_join
from lectio.operators.sequence import with_row_number

#: Turns of a block: what one row may hold.
BLOCK_TURNS = 1 << 14
#: Turns that one shard's tree holds, about.
SHARD_TURNS = 1 << 18
#: Characters of an id list that travel as one row.
CHUNK_CHARS = 1 << 16
#: Every conversation may borrow the first turns of the one at the next lower
#: multiple of FAMILY: as many as its hash modulo MOST_BORROWED + 1.
FAMILY, MOST_BORROWED = 5, 8

KEYS = ["s1", "s2", "ids"]
PARTIAL = T.StructType([T.StructField(c, T.LongType()) for c in (
    "shard", "depth", "k1", "k2", "p1", "p2", "conv", "n", "children", "leaves", "saved", "parent_conv")] + [
    T.StructField(c, T.BooleanType()) for c in ("open", "parent_open", "top")])


# -- turns ----------------------------------------------------------------------
def encoded_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, place, id, bytes)`` for every turn, places from 0, and
    ``(conv, n)``: the conversations and their numbers of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
                                key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    rows = with_row_number(rows.filter("conv IS NOT NULL"), ["conv", F.asc_nulls_first("turn"), "role", "key"], "row")
    total = rows.count()
    dictionary = with_row_number(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], "id")
    convs = stage(rows.groupBy("conv").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "trie-convs")
    rows = counted_join(rows.select("conv", "row", "key", "bytes"), dictionary, ["key"], total)
    rows = counted_join(rows.drop("key"), convs, ["conv"], total)
    turns = rows.select("conv", (F.col("row") - F.col("first")).alias("place"), "id", "bytes")
    return stage(turns, "trie-turns"), convs.select("conv", "n")


def families(turns: DataFrame, convs: DataFrame, family: int = FAMILY, most: int = MOST_BORROWED):
    """Conversations that share beginnings: conversation c has the first h
    turns of conversation c - c % family, h being its id's CRC-32 modulo
    most + 1, and then its own turns after its first h.  ``(turns, convs)`` as
    before."""
    total = turns.count()
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1))
    known = convs.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), h.alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = known.join(bases, "base", "left").select(
        "conv", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared"))
    known = stage(known, "trie-families")
    own = counted_join(turns, known.select("conv", "n", "h", "shared"), ["conv"], total)
    own = own.filter("place >= h").select("conv", (F.col("shared") + F.col("place") - F.col("h")).alias("place"), "id", "bytes")
    heads = turns.filter(f"place < {most} AND conv % {family} = 0").withColumnRenamed("conv", "base")
    lent = known.filter("shared > 0").select("conv", "base", "shared").join(heads, "base").filter("place < shared")
    made = own.unionByName(lent.select("conv", "place", "id", "bytes"))
    lengths = known.select("conv", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return made, lengths


# -- sequences --------------------------------------------------------------------
def blocks(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Conversations cut into blocks: conv, block, ids, sizes, a and b (the
    turns' hashes), s1 and s2 (key of the prefix before), e1 and e2 (key at
    the end), last.  A conversation without turns has one empty block."""
    hashed = turns.select("conv", "place", "id", "bytes", *[F.xxhash64(F.lit(i), "place", "id").alias(c)
                                                            for i, c in ((1, "a"), (2, "b"))])
    turn = F.struct("place", "id", "bytes", "a", "b")
    cut = hashed.groupBy("conv", F.expr(f"place DIV {block_turns}").alias("block")).agg(
        F.array_sort(F.collect_list(turn)).alias("t"), F.bit_xor("a").alias("x1"), F.bit_xor("b").alias("x2"))
    cut = cut.select("conv", "block", F.col("t.id").alias("ids"), F.col("t.bytes").alias("sizes"),
                     F.col("t.a").alias("a"), F.col("t.b").alias("b"), "x1", "x2")
    none = F.array().cast("array<bigint>")
    empty = convs.filter("n = 0").select("conv", F.lit(0).cast("long").alias("block"), *[none.alias(c) for c in (
        "ids", "sizes", "a", "b")], *[F.lit(0).cast("long").alias(c) for c in ("x1", "x2")])
    order = Window.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    keyed = cut.unionByName(empty)
    for i in "12":
        start = F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0))
        keyed = keyed.withColumn(f"s{i}", start).withColumn(f"e{i}", F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")))
    return keyed.withColumn("last", F.lead("block").over(order).isNull()).drop("x1", "x2")


def distinct_sequences(cut: DataFrame) -> DataFrame:
    """One row per distinct block: its arrays, n (members) and conv (the
    smallest)."""
    keys = ["block", "s1", "s2", "e1", "e2", F.size("ids").alias("len")]
    groups = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    return cut.drop("last").join(groups.select("conv", "block", "n"), ["conv", "block"])


# -- trees ------------------------------------------------------------------------
class TernaryTree:
    """A ternary search tree over sequences of integers.  Node 0 is the empty
    sequence; ``eq`` leads to a node's continuations, which ``lo`` and ``hi``
    search.  ``up`` is the trie's parent."""

    def __init__(self, key: tuple[int, int]):
        self.split, self.lo, self.eq, self.hi = [0], [-1], [-1], [-1]
        self.up, self.depth, self.size, self.k1, self.k2 = [-1], [0], [0], [key[0]], [key[1]]
        self.n, self.conv, self.tail = [0], [None], {}

    def _new(self, turn: int, up: int, size: int, a: int, b: int) -> int:
        self.split.append(turn)
        for links in (self.lo, self.eq, self.hi):
            links.append(-1)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.size.append(size)
        self.k1.append(self.k1[up] ^ a)
        self.k2.append(self.k2[up] ^ b)
        self.n.append(0)
        self.conv.append(None)
        return len(self.up) - 1

    def insert(self, ids, sizes, a, b, n: int, conv: int, tail: tuple[int, int, int]) -> None:
        split, lo, eq, hi, node = self.split, self.lo, self.eq, self.hi, 0
        for d, turn in enumerate(ids):
            at, links, parent = eq[node], eq, node
            while at >= 0 and split[at] != turn:
                links, parent = (lo if turn < split[at] else hi), at
                at = links[parent]
            if at < 0:
                at = self._new(turn, node, sizes[d], a[d], b[d])
                links[parent] = at
            node = at
        self.n[node], self.conv[node], self.tail[node] = n, conv, tail

    def path(self, ids) -> list[int]:
        """The nodes of as many first turns as the tree has."""
        found = [0]
        for turn in ids:
            at = self.eq[found[-1]]
            while at >= 0 and self.split[at] != turn:
                at = self.lo[at] if turn < self.split[at] else self.hi[at]
            if at < 0:
                break
            found.append(at)
        return found

    def order(self) -> list[int]:
        """All nodes, parents before children."""
        out, stack = [0], [self.eq[0]]
        while stack:
            at = stack.pop()
            if at >= 0:
                out.append(at)
                stack += (self.hi[at], self.lo[at], self.eq[at])
        return out


def median_order(n: int):
    """0 .. n-1, the median first, then the medians of the halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += ((a, mid), (mid + 1, b))


def partial_nodes(rows: list, before, after, depth: int):
    """The node rows of one shard's tree below one prefix.  ``rows``: sorted
    sequences (s1, s2, ids, sizes, a, b, n, conv, tail children, leaves,
    saved); ``before`` and ``after``: the neighbouring shards' nearest ids
    under this prefix, or None; ``depth``: turns before the block."""
    tree = TernaryTree(rows[0][:2])
    for i in median_order(len(rows)):
        tree.insert(*rows[i][2:8], rows[i][8:11])
    count = len(tree.up)
    first, is_open, longer = [1] * count, [False] * count, [False] * count
    if before is not None:
        for at in tree.path(before):
            first[at], is_open[at] = 0, True
    if after is not None:
        for at in tree.path(after):
            is_open[at] = True
            longer[at] = tree.depth[at] < len(after)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    n, conv, up = tree.n, tree.conv, tree.up
    order = tree.order()
    for at in reversed(order):  # children before parents
        more, below, gain = tree.tail.get(at, (0, 0, 0))
        children[at] += more
        leaves[at] += below
        saved[at] += gain + (n[at] - first[at]) * tree.size[at]
        if tree.eq[at] < 0 and not more and not longer[at]:
            leaves[at] += 1
        parent = up[at]
        if parent >= 0:
            n[parent] += n[at]
            children[parent] += first[at]
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
            conv[parent] = conv[at] if conv[parent] is None else min(conv[parent], conv[at])
    for at in order:
        parent, top = up[at], at == 0 and depth > 0
        below = parent == 0 and depth > 0  # its parent is a node of the level above
        parent_open = parent >= 0 and (below or is_open[parent])
        yield (depth + tree.depth[at], tree.k1[at], tree.k2[at], tree.k1[parent] if parent >= 0 else None,
               tree.k2[parent] if parent >= 0 else None, conv[at], n[at], children[at], leaves[at], saved[at],
               None if parent < 0 or parent_open else conv[parent], is_open[at], parent_open, top)


def _level(rows: DataFrame, depth: int, shard_turns: int) -> DataFrame:
    """The partial nodes of one block level, written: those of its sequences'
    trees, with the shard."""
    total = rows.agg(F.sum(F.size("ids") + F.lit(1))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // shard_turns)), *KEYS).sortWithinPartitions(*KEYS)
    dealt = stage(dealt.withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")
    # a row per shard: the nearest sequences of its neighbours
    nearest = F.struct(*KEYS)
    edges = dealt.groupBy("shard").agg(F.min(nearest).alias("lo"), F.max(nearest).alias("hi"))
    by_shard = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("hi").over(by_shard).alias("before"), F.lead("lo").over(by_shard).alias("after"))
    names = ["shard", "kind", *KEYS, "sizes", "a", "b", "n", "conv", "t_children", "t_leaves", "t_saved"]
    fences = [edges.filter(f"{c} IS NOT NULL").select("shard", F.lit(kind).alias("kind"), f"{c}.*")
              for c, kind in (("before", 0), ("after", 2))]
    every = dealt.withColumn("kind", F.lit(1)).select(*names)
    for f in fences:
        every = every.unionByName(f, allowMissingColumns=True)
    every = every.select(*names).repartition("shard").sortWithinPartitions("shard", "kind", *KEYS)
    arrow = to_arrow_schema(PARTIAL)

    def run(it):
        for group in _streamed_groups(it):
            before = [r for r in group if r[1] == 0]
            after = [r for r in group if r[1] == 2]
            own = [r for r in group if r[1] == 1]
            start, out = 0, []
            for i in range(1, len(own) + 1):
                if i < len(own) and own[i][2:4] == own[start][2:4]:
                    continue
                prefix = own[start][2:4]
                near = [next((r[4] for r in side if r[2:4] == prefix), None) for side in (before, after)]
                part = [r[2:] for r in own[start:i]]
                for row in partial_nodes(part, *near, depth):
                    out.append((own[0][0], *row))
                    if len(out) >= 1 << 14:
                        yield _batch(out, arrow)
                        out = []
                start = i
            if out:
                yield _batch(out, arrow)

    return stage(every.mapInArrow(run, PARTIAL), "trie-partials")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


SUMS = ("n", "children", "leaves", "saved")


def _merged(partials: DataFrame, level: int) -> DataFrame:
    """A level's nodes: those inside a shard as they are, boundary nodes
    summed over the shards that have them."""
    nodes = partials.filter("NOT top").drop("top").withColumn("level", F.lit(level))
    inside = nodes.filter("NOT open").drop("open")
    joined = nodes.filter("open").groupBy("level", "depth", "k1", "k2").agg(
        F.min("shard").alias("shard"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in SUMS], F.min("parent_conv").alias("parent_conv"),
        F.max("parent_open").alias("parent_open"))
    return inside.unionByName(joined)


def nodes(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS,
          shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  ``turns``
    and ``convs`` as from :func:`encoded_turns`."""
    cut = stage(blocks(turns, convs, block_turns), "trie-blocks")
    sequences = stage(distinct_sequences(cut), "trie-sequences")
    last = sequences.agg(F.max("block")).first()[0] or 0
    found, tails = [], None
    for level in range(last, -1, -1):
        rows = sequences.filter(F.col("block") == level)
        if tails is not None:
            rows = rows.join(tails, ["e1", "e2"], "left")
        zero = F.lit(0).cast("long")
        rows = rows.select("conv", *KEYS, "sizes", "a", "b", "n", *[
            (zero if tails is None else F.coalesce(c, zero)).alias(c) for c in ("t_children", "t_leaves", "t_saved")])
        partials = _level(rows, level * block_turns, shard_turns)
        tails = partials.filter("top").groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2")).agg(
            *[F.sum(c).alias(f"t_{c}") for c in SUMS[1:]])
        found.append(_merged(partials, level))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stage(every, "trie-nodes")

    # parents outside the shard's tree: looked up once per shard, so a node
    # with very many children is no hot key
    names = every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("d"),
                         F.col("conv").alias("above"))
    asked = every.filter("parent_open").select("level", "shard", "p1", "p2", (F.col("depth") - 1).alias("d")).distinct()
    answers = asked.join(names, ["p1", "p2", "d"]).drop("d")
    every = every.join(answers, ["level", "shard", "p1", "p2"], "left")
    every = every.withColumn("parent", F.coalesce("above", "parent_conv"))
    ends = member_digests(cut.filter("last").select("e1", "e2", "conv"))
    every = every.join(ends, (every["k1"] == ends["e1"]) & (every["k2"] == ends["e2"]), "left")
    nothing = hashlib.sha256().hexdigest()
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"))


def member_digests(members: DataFrame) -> DataFrame:
    """``(e1, e2, digest)``: SHA-256 of each key's decimal conv ids, ascending
    and joined by commas.  A key's ids are first joined to chunks where they
    lie sorted; the digest then streams over its chunks, so no group is held."""
    order = ["e1", "e2", "conv"]
    chunk = T.StructType([T.StructField(c, T.LongType()) for c in order] + [T.StructField("text", T.StringType())])
    schema = T.StructType([*chunk.fields[:2], T.StructField("digest", T.StringType())])
    arrow, arrow_out = to_arrow_schema(chunk), to_arrow_schema(schema)

    def join(it):
        key, ids, size = None, [], 0
        for b in it:
            out = []
            for e1, e2, conv in zip(*(c.to_pylist() for c in b.columns)):
                if ids and ((e1, e2) != key or size >= CHUNK_CHARS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                key = (e1, e2)
                ids.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield _batch(out, arrow)
        if ids:
            yield _batch([(*key, ids[0], ",".join(map(str, ids)))], arrow)

    def digest(it):
        key, state = None, None
        for b in it:
            out = []
            for e1, e2, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if (e1, e2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (e1, e2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield _batch(out, arrow_out)
        if key is not None:
            yield _batch([(*key, state.hexdigest())], arrow_out)

    lists = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, chunk)
    return lists.repartition("e1", "e2").sortWithinPartitions(*order).mapInArrow(digest, schema)


def prefix_trie(conversations: DataFrame, **limits) -> DataFrame:
    """The nodes of the conversations as they are."""
    return nodes(*encoded_turns(conversations), **limits)


def family_trie(conversations: DataFrame, **limits) -> DataFrame:
    """The nodes of the conversations rebuilt with shared beginnings."""
    return nodes(*families(*encoded_turns(conversations)), **limits)
