"""The conversation trie against brute force, in one level and many shards."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from lectio.llm import turn_trie
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def turn_key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, role, turn_key(role, text), text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        turns = tuple(turns)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
        ends[turns].append(c)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_rows():
    """Null ids, turns, roles and texts, repeated rows, ties, negative ids, and
    many conversations of few texts (long shared beginnings)."""
    rng = random.Random(7)
    rows = [(None, 0, "user", "nobody's"), (3, None, "user", "x"), (3, None, "user", "x"), (3, 1, None, None),
            (-7, 0, "user", "é"), (-7, 0, "assistant", "é"), (-5, 0, "user", "a"), (2**40, 0, "user", "a"), (9, 5, "", "")]
    for c in range(10, 90):
        for t in range(rng.choice([1, 1, 2, 5, 9, 14])):
            rows.append((c, t, "user", rng.choice("aab")))
    for c in range(100, 130):  # copies of one conversation
        rows += [(c, t, "user", "same") for t in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_turns": 3, "shard_turns": 40}])
def test_trie_equals_brute_force(spark, limits):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, f"p{i}") for i, r in enumerate(rows)],
                               T.StructType([*SCHEMA.fields, T.StructField("place", T.StringType())])).repartition(4)
    assert rows_of(turn_trie.family_trie(df, **limits)) == trie(rebuilt(sequences(rows)))
    assert rows_of(turn_trie.prefix_trie(df, **limits)) == trie(sequences(rows))


def test_query_table_and_empty_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(turn_trie.family_trie(df)) == trie(rebuilt(sequences(rows)))
    assert turn_trie.family_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_is_balanced():
    """The median first keeps the search for a root's child short."""
    tree = turn_trie.TernaryTree((0, 0))
    for i in turn_trie.median_order(1000):
        tree.insert([i], [1], [i], [i], 1, i, (0, 0, 0))
    depth, stack = 0, [(tree.eq[0], 1)]
    while stack:
        at, d = stack.pop()
        if at >= 0:
            depth = max(depth, d)
            stack += [(tree.lo[at], d + 1), (tree.hi[at], d + 1)]
    assert depth == 10
    assert sorted(turn_trie.median_order(17)) == list(range(17))


def test_member_lists_longer_than_a_chunk(spark):
    n = 30_000  # several chunks of one key
    df = spark.range(n).selectExpr("1L AS e1", "2L AS e2", "id AS conv").repartition(5)
    digest = turn_trie.member_digests(df).collect()
    want = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert [tuple(r) for r in digest] == [(1, 2, want)]
