"""SpotSigs, substring dedup, chat formatting, exact dedup and the n-gram
Jaccard join against brute force, on odd rows and on crafted groups."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm import chat, exact, ngram_join, queries, spotsigs, substring
from lectio.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.conftest import SCHEMA, TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def random_docs(n, seed, vocabulary=12, longest=60, copies=0.5):
    """Texts of few words with stretches and near copies of earlier ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, longest))]
        if out and rng.random() < copies:
            other = words(rng.choice(out)[1])
            a = rng.randint(0, len(other))
            b = rng.randint(a, len(other))
            kind = rng.random()
            if kind < 0.4:  # a stretch of another document
                text = text[:20] + other[a:b] + text[20:]
            elif kind < 0.9 and other:  # a copy with a change
                text = [*other]
                text[rng.randrange(len(text))] = "new"
            else:
                text = [w.upper() for w in other]
        out.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rng.shuffle(out)
    return out


# -- spotsigs ---------------------------------------------------------------------
def spots(text):
    """Signatures as strings: anchor with the next two content words."""
    anchors = set(spotsigs.anchor_words())
    tokens = [w for w in regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split(" ") if w]
    if tokens and tokens[-1] in anchors:
        last = len(tokens) - 1
    else:
        last = None
    content = [i for i, w in enumerate(tokens) if w not in anchors or i == last]
    out = set()
    for i, w in enumerate(tokens):
        after = [j for j in content if j > i][:2]
        if w in anchors and i != last and after:
            out.add((w, " ".join(tokens[j] for j in after)))
    return out or {("whole", text or "")}


def test_signatures_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    found = spotsigs.with_signatures(rows, F.col("text"), "s").select("doc_id", "text", "s").collect()
    meaning = {}
    for r in found:
        want = spots(r.text)
        assert len(r.s) == len(want) and r.s == sorted(r.s)
        for x in want:
            key = r.s[0] if x[0] == "whole" else None
            if key is not None:
                assert meaning.setdefault(x, key) == key
    # the same signatures make the same likeness
    pairs = random.Random(1).sample([(a, b) for a in found[:60] for b in found[:60]], 400)
    frame = spark.createDataFrame([(a.s, b.s) for a, b in pairs], "a array<bigint>, b array<bigint>")
    got = [r[0] for r in frame.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()]
    for (a, b), v in zip(pairs, got):
        x, y = spots(a.text), spots(b.text)
        assert v == pytest.approx(len(x & y) / len(x | y))


def _ring(docs):
    ids = sorted({i for i, _ in docs}, key=lambda i: (i is None, -(i or 0)))
    text = {i: max((t or "" for j, t in docs if j == i), key=len) for i in ids}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        own, half = text[i], len(text[i]) // 2
        yield i, own, own[:len(own) - half] + text[nxt][:half], text[nxt]


@pytest.mark.parametrize("source", ["table", "odd", "one"])
def test_edited_texts_and_likeness(spark, odd, source):
    docs = {"table": spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"), "odd": odd,
            "one": spark.createDataFrame([(4, "the house of the rising sun")], SCHEMA)}[source]
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = spotsigs.with_edited(docs).select(
        "doc_id", "text", "edited", spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        F.col("fingerprint").alias("f")).collect()
    lead = {i: nxt for i, _, _, nxt in _ring(plain)}
    want = Counter()
    for i, t in plain:  # every row, also one that repeats an id or has none
        own, half = t or "", len(t or "") // 2
        edited = own[:len(own) - half] + lead[i][:half]
        near = [len(a & b) / len(a | b) for a, b in ((spots(own), spots(other)) for other in (edited, lead[i]))]
        want[i, own, edited, *[round(v, 9) for v in near]] += 1
    assert Counter((r.doc_id, r.text, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == want
    prints = {}
    for r in rows:
        assert prints.setdefault(r.text, r.f) == r.f and re.fullmatch("[0-9a-f]{32}", r.f)


@pytest.mark.parametrize("share_rows", [2, 4096])
def test_rows_without_or_with_repeated_ids_stay(spark, share_rows):
    rng = random.Random(3)
    docs = [(rng.choice([None, None, 3, 4, i + 10]),
             rng.choice([None, "", "the end", " ".join(rng.choices(["the", "of", "w1", "w2", "w3", "w4"], k=rng.randint(1, 30)))]))
            for i in range(60)]
    table = spark.createDataFrame(docs, SCHEMA).repartition(4)
    rows = spotsigs.with_edited(table, share_rows=share_rows).select(
        "doc_id", "text", "edited", "fingerprint", "next_fingerprint",
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next")).collect()
    lead = {i: nxt for i, _, _, nxt in _ring(docs)}
    want = Counter()
    for i, t in docs:
        own, half = t or "", len(t or "") // 2
        want[i, own, own[:len(own) - half] + lead[i][:half]] += 1
    assert Counter((r.doc_id, r.text, r.edited) for r in rows) == want
    prints = {r.text: r.fingerprint for r in rows}
    for r in rows:
        # of equally long texts either may lead
        assert r.next_fingerprint in {prints[t or ""] for _, t in docs if len(t or "") == len(lead[r.doc_id])}
        if r.next_fingerprint == prints[lead[r.doc_id]]:
            a, b = spots(r.text), spots(lead[r.doc_id])
            assert r.near_next == pytest.approx(len(a & b) / len(a | b))


def test_op5_keeps_rows_without_id(spark, tmp_path):
    docs = [(None, "the one of them"), (None, "a text of its own"), (5, "the two"), (5, "the two"), (None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op5_spotsigs(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((i, len(t or "")) for i, t in docs)


def test_long_equal_neighbours_are_alike(spark):
    """Of so many signatures some agree in half of their bits."""
    n = 150_000
    docs = [(i, " ".join(f"the w{k}" for k in range(n))) for i in (1, 2)]
    rows = spotsigs.with_edited(spark.createDataFrame(docs, SCHEMA)).select(
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"), F.size("signatures").alias("n"),
        F.size(F.array_distinct(F.transform("signatures", lambda x: F.shiftright(x, 32)))).alias("halves")).collect()
    assert len(rows) == 2 and all(r.near_next == 1.0 and r.halves < r.n for r in rows)


def test_spotsigs_of_no_rows(empty):
    assert spotsigs.with_edited(empty).count() == 0


def test_length_pruning_changes_no_similar_pair(spark):
    sets = [list(range(a, b)) for a in range(0, 12, 3) for b in range(a + 1, 40, 4)]
    frame = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<bigint>, b array<bigint>")
    full, pruned = spotsigs.likeness(F.col("a"), F.col("b")), spotsigs.likeness(F.col("a"), F.col("b"), 0.75)
    apart = F.abs(spotsigs.length_class(F.col("a")) - spotsigs.length_class(F.col("b")))
    for v, p, d in frame.select(full, pruned, apart).collect():
        assert p == (v if v >= 0.75 else p) and p in (0.0, v)
        assert d <= 1 or v < 0.75


# -- substring dedup ----------------------------------------------------------------
def removed(docs, k):
    """Which words go, by the definition."""
    first = {}
    for i, t in docs:
        w = words(t)
        for a in range(len(w) - k + 1):
            if i is not None:
                g = tuple(w[a:a + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a:a + k])] < i:
                gone[a:a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,vocabulary,k", [(1, 3, 13), (3, 40, 6)])
def test_repeated_spans_equal_brute_force(spark, seed, vocabulary, k):
    docs = random_docs(150, seed, vocabulary)
    rows = substring.cut(spark.createDataFrame(docs, SCHEMA).repartition(4), k).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str) == removed(docs, k)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeated_spans_of_odd_rows(odd, empty):
    rows = substring.cut(odd).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str) == removed(TEXTS, 13)
    kept = substring.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS)
    assert {r.text for r in kept.filter("doc_id = 9").collect()} == {TEXTS[9][1]}
    assert substring.cut(empty).count() == 0 == substring.without_repeats(empty).count()


# -- chat -----------------------------------------------------------------------------
NASTY = ["", "\\", "\\0", "\\1<", "<turn role=\"user\">", "</turn>\n", "a\\>b<c", "\\\\01\\2", "### Assistant:", "é😀\n\n", "\">"]


def test_template_reads_back_any_text(spark):
    rng = random.Random(2)
    convs = [[(rng.choice(["user", "assistant", "a>\"b<", ""]), rng.choice(NASTY) + rng.choice(NASTY))
              for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = [(i, n, [{"role": r, "text": t}]) for i, c in enumerate(convs) for n, (r, t) in enumerate(c)]
    frame = spark.createDataFrame(rows, "id long, n int, turns array<struct<role:string,text:string>>").repartition(5)
    made = chat.format_turns(frame, "id", ["n"]).select(
        "id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_learned(F.col("formatted"), F.col("loss_spans")).alias("learned"), "loss_spans").collect()
    for r in made:
        c = convs[r.id]
        assert [(t.role, t.text) for t in r.turns] == c
        assert r.learned == [t for role, t in c if role == "assistant"]
        assert all("<" not in r.formatted[s.start:s.end] for s in r.loss_spans)


def test_fingerprints_select_layouts(spark):
    system, user, bot = ("system", "s"), ("user", "q"), ("assistant", "a")
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [user, bot]),
        ({"messages": [{"content": "q", "role": "user"}]}, "messages", [user]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}]}, "message parts", [user]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [user, bot]),
        ({"prompt": "q", "response": "a"}, "prompt and response", [user, bot]),
        ({"prompt": "q", "response": "a", "system": "s"}, "prompt and response", [system, user, bot]),
        ({"prompt": "q", "completion": "a"}, "prompt and completion", [user, bot]),
        ({"question": "q", "answer": None}, "question and answer", [user, ("assistant", None)]),
        ({"instruction": "q", "output": "a"}, "instruction", [user, bot]),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [user, ("user", "i"), bot]),
        ({"role": "user", "text": "q"}, "turn", [user]),
        ({"role": "user", "content": "q"}, "message", [user]),
        ({"something": {"else": 1}}, None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(cases)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id int, raw string").withColumn("record", F.parse_json("raw")).withColumn("turns", F.lit(1))
    got = {r.id: r for r in chat.canonical(frame).drop("record").collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert (got[i].layout, [(t.role, t.text) for t in got[i].turns]) == (name, turns)
    assert got[99].layout is None and got[99].turns == []
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint


def test_chat_rows_with_nulls_ties_and_none(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 1, None, "x"), (None, 0, "user", "y"),
            (2, 5, "assistant", "z" * 100_000), (2, 5, "assistant", "z" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "conv_id", "turn", F.array(F.struct("role", "text")).alias("turns"), F.lit(1).alias("id"))
    made = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_turns(frame, "conv_id", ["turn"]).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert made[1] == [("assistant", ""), ("user", "a"), ("user", "b")]
    assert made[None] == [("user", "y"), ("", "x")]
    assert made[2] == [("assistant", "z" * 100_000)] * 2
    assert chat.format_turns(frame.limit(0), "conv_id", ["turn"]).count() == 0


# -- exact dedup ------------------------------------------------------------------------
def groups(docs, best):
    size = Counter(fold(t) for _, t in docs)
    keep = {}
    for i, t in docs:
        ids = [x for x in (keep.get(fold(t)), i) if x is not None]
        keep[fold(t)] = best(ids) if ids else None
    return sorted(((i, keep[fold(t)], size[fold(t)], i == keep[fold(t)], hashlib.sha256(fold(t).encode()).hexdigest())
                   for i, t in docs), key=str)


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, odd, monkeypatch, collide, keep):
    if collide:  # every text has the same hash: the bytes decide
        monkeypatch.setattr(exact, "content_hash", lambda c: F.lit(b"same"))
    best = min if keep == "smallest" else max
    got = sorted((tuple(r) for r in exact.exact_dedup(odd, keep=keep, share_rows=2).collect()), key=str)
    assert got == groups(TEXTS, best)
    docs = random_docs(120, 8, vocabulary=2, longest=3)
    got = sorted((tuple(r) for r in exact.exact_dedup(spark.createDataFrame(docs, SCHEMA), keep, share_rows=3).collect()), key=str)
    assert got == groups(docs, best)


def test_exact_of_no_rows(empty):
    assert exact.exact_dedup(empty).count() == 0


# -- n-gram Jaccard join --------------------------------------------------------------------
def jaccard_groups(docs):
    sets = {}
    for i, t in docs:
        w = words(fold(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[a:a + 5]) for a in range(len(w) - 4)}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("seed,longest,kw", [(2, 8, {}), (3, 120, {"share": 2, "common": 0}),
                                             (4, 40, {"share": 3, "sample_docs": 10**6})])
def test_components_equal_brute_force(spark, seed, longest, kw):
    docs = random_docs(160, seed, vocabulary=6 if seed == 2 else 30, longest=longest, copies=0.8)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(4), **kw).collect()
    assert sorted(map(tuple, got)) == jaccard_groups(docs)


def test_one_large_group_of_near_copies(spark):
    """A base and many copies with changes: the copies link through the base
    and through each other, whichever block they meet in."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    docs = [(1000, " ".join(base))]
    for i in range(90):
        copy = [*base]
        for _ in range(rng.choice([1, 2])):
            copy[rng.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(4), share=4).collect()
    assert sorted(map(tuple, got)) == jaccard_groups(docs)


def test_components_of_odd_rows(odd, empty):
    got = ngram_join.jaccard_components(odd).collect()
    plain = [(i, t) for i, t in TEXTS if i is not None]
    want = {i: (n, c) for i, n, c in jaccard_groups(plain)}
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None
    assert ngram_join.jaccard_components(empty).count() == 0


def test_tree_traversal_loses_no_linked_pair():
    import numpy as np
    rng = random.Random(3)
    sets = []
    for _ in range(120):
        s = set(rng.sample(range(400), rng.randint(1, 60))) if not sets or rng.random() < 0.4 else set(rng.choice(sets))
        for _ in range(rng.randint(0, 4)):
            s.add(rng.randrange(400))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    arrays = [np.sort(a) for a in arrays]
    want = {(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    size = np.array([len(a) for a in arrays])
    for cut in (8, 64):  # signatures of 64 and 512 bits
        maps = ngram_join.folded([ngram_join.signature(a) for a in arrays] + [bytes(cut)])[:-1]
        tree = ngram_join.SignatureTree(maps, size, fan=3)
        pairs = {(max(x, y), min(x, y)) for i, j, _ in ngram_join.leaf_pairs(tree, tree) for x, y in zip(i.tolist(), j.tolist())}
        assert want <= pairs and all(i != j for i, j in pairs)
        a, b = ngram_join.SignatureTree(maps[:50], size[:50]), ngram_join.SignatureTree(maps[50:], size[50:])
        across = {(j + 50, i) for x, y, _ in ngram_join.leaf_pairs(a, b) for i, j in zip(x.tolist(), y.tolist())}
        assert {(i, j) for i, j in want if j < 50 <= i} <= across
    assert len(pairs) < 120 * 119 / 4  # and most others are pruned


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


# -- the registered queries -------------------------------------------------------------------
def test_op5_covers_the_table(spark):
    rows = queries.op5_spotsigs(spark, SF_SMALL).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(own), hashlib.sha256(edited.encode()).hexdigest()) for i, own, edited, _ in _ring(docs)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want


def test_op9_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_ngram_jaccard(spark, SF_SMALL).collect())) == jaccard_groups(docs)
