"""Bottom-k near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from lectio.llm import bottomk
from lectio.llm.skew import counted_join
from tests.conftest import SF_SMALL
from tests.llm.conftest import SCHEMA
from tests.llm.test_text_operators import fold, words


def shingles(text, k=2):
    w = words(fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=80):
    ids = [i for i, _ in rows if i is not None]
    first = {i: i for i in ids}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    sets = [(i, s) for i, s in sets if s]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            low, high = sorted((len(a), len(b)))
            if 100 * low >= percent * high and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                first[max(p, q)] = min(p, q)
    out = []
    for i, t in rows:
        c = None if i is None else find(i)
        out.append((i, len(shingles(t)), c, i is None or c == i))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in bottomk.near_duplicates(df, **kw).collect()), key=repr)


def chained(n, rng, length=120):
    """Copies that each change a few words of the one before."""
    text = [f"v{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        text = [*text]
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(length)] = f"u{rng.randrange(4000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("share", [256, 8])
def test_near_copies_equal_all_pairs(spark, share):
    rng = random.Random(share)
    common = " ".join(f"p{i}" for i in range(40))
    texts = chained(60, rng) + chained(20, rng, 400)
    texts += [f"{common} " + " ".join(f"x{rng.randrange(900)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [(i, t.upper()) for i, t in rng.sample(rows, 5)]  # repeated ids
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df, share=share) == brute(rows)


def test_odd_rows_and_tables(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    rows += [(20, "one id with"), (20, "several different texts"), (21, "several different texts"), (22, "one id with")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows[-4:], SCHEMA))
    assert found(df) == brute(rows)
    assert found(empty) == []
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_estimates():
    """Whole sketches give the Jaccard itself, others come near it."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    small = [np.sort(base[a:b]) for a, b in ((0, 100), (10, 100), (50, 130))]
    got = bottomk.union_estimates(small, np.ones(3, bool))
    for i, a in enumerate(small):
        for j, b in enumerate(small):
            assert got[i, j] == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    big = [np.sort(base[:4000]), np.sort(base[400:4400])]
    estimate = bottomk.union_estimates([s[:bottomk.SKETCH] for s in big], np.zeros(2, bool))[0, 1]
    assert abs(estimate - 3600 / 4400) < 0.15
    assert (np.diagonal(bottomk.union_estimates([s[:128] for s in big], np.zeros(2, bool))) == 1).all()


def test_forest_joins_components_once():
    i, j = np.triu_indices(6, 1)
    weight = np.linspace(1, 0, len(i))
    at = bottomk.spanning_forest(i, j, weight, np.array([5, 5, 7, 8, 8, 9]))
    component = np.array([5, 5, 7, 8, 8, 9])
    joined = {frozenset((component[i[k]], component[j[k]])) for k in at.tolist()}
    assert joined == {frozenset(p) for p in ((5, 7), (5, 8), (5, 9))}  # the heaviest pair of each


def test_counted_join_with_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS v")
    table = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS w")
    got = counted_join(rows, table, ["k"], 3000)
    assert got.columns == ["k", "v", "w"] and got.count() == 3000 and got.filter("w <> 2 * k").isEmpty()


def test_copies_of_a_large_component_grow_with_the_others(spark):
    sizes = {7: 400, 900: 30, 901: 10, 902: 1}  # component: documents
    ids = [(c, 1000 * c + k) for c, n in sizes.items() for k in range(n)]
    src = spark.createDataFrame([(1, 5, i, 5, c) for c, i in ids] + [(2, 5, i, 5, 7) for c, i in ids if c == 7]
                                + [(3, 5, 7000, 5, 7), (3, 5, 900000, 5, 900)],
                                "t long, at int, id long, own int, component long")
    rows = bottomk.dealt_parts(src, 64).collect()
    # formerly every document had a copy for each of 14 parts
    assert sum(r.t == 1 for r in rows) <= 2 * 400 + 41 * 16
    assert not [r for r in rows if r.t == 2] and len([r for r in rows if r.t == 3]) == 2
    groups = {}
    for r in rows:
        groups.setdefault((r.t, r.g), []).append(r)
    met = {frozenset((a.id, b.id)) for (t, _), g in groups.items() if t == 1 for x, a in enumerate(g) for b in g[:x]
           if a.component != b.component}
    want = {frozenset((i, j)) for c, i in ids for d, j in ids if c != d}
    assert met == want
