"""Byte-level BPE, packing, training order and token counts after edits."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from lectio.llm import bpe, bytebpe, packing, queries, token_counts, training_order
from tests.conftest import SF_SMALL
from tests.llm.conftest import TEXTS

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "²", "½", "\x1c", "\x85", "\xa0", "Ⅷ", "中",
         "文", "😀", "​", "　", "<|endoftext|>", "the ", " of", "x", "X", "=", "--", "_", "...", "\x00", "ʰ", "́"]


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tok, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n, seed=3):
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    runs = ["".join(rng.choice(c) for _ in range(rng.randint(0, 80))) for c in
            (rng.sample("aehn =-.<0\n ", 2) for _ in range(n))]
    return mixed + runs + [t or "" for _, t in TEXTS]


def test_ids_equal_the_libraries(library):
    tok, tik = library
    a, b = bpe.ByteBpe(JSON), bpe.ByteBpe(RANKS)
    for text in _random_texts(600):
        assert a.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
        assert b.encode(text).tolist() == tik.encode_ordinary(text)
        assert a.decode(a.encode(text)) == b.decode(b.encode(text)) == text.encode()


def test_full_table_and_pieces_change_nothing(library, monkeypatch):
    tok, _ = library
    small = bpe.ByteBpe(JSON, capacity=5)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    text = "".join(_random_texts(200))
    assert small.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(small.known) <= 5


def test_character_classes_of_the_shortcut():
    import regex
    letters = {c for c in map(chr, range(0x2B0)) if regex.match(r"\p{L}", c)}
    numbers = {c for c in map(chr, range(0x2B0)) if regex.match(r"\p{N}", c)}
    simple = {c for c in map(chr, range(0x2B0)) if not bpe._OTHER.search(c)}
    import re
    assert {c for c in simple if re.match(f"[{bpe._LETTERS}]", c)} == letters & simple
    assert numbers & simple == set("0123456789")


def test_the_shortcut_is_told_by_the_same_characters():
    for c in [*map(chr, range(0x400)), "中", "😀"]:
        assert bpe.needs_library(f"a{c}b") == bool(bpe._OTHER.search(c))


def test_a_pretoken_is_looked_up_once_for_many_texts(library):
    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

    b = bpe.ByteBpe(JSON)
    b.known = Counting()
    texts = ["the cat the cat", "naïve the 中 the", "", " the"] * 30
    got = b.encode_many(texts)
    assert [x.tolist() for x in got] == [library[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert Counting.asked <= 4  # formerly once for each occurrence


def test_encode_and_decode_rows(spark, odd, empty, library):
    _, tik = library
    rows = bytebpe.decode(bytebpe.encode(odd, RANKS, offsets=True).withColumn("decoded", F.lit(1)), RANKS)
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in rows.collect())
    want = sorted((str(i), np.array(tik.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert got == want
    assert bytebpe.encode(empty, RANKS).count() == 0


def test_offsets_and_split_characters(spark):
    text = "aé😀b 中"
    b = bpe.encoder(RANKS)
    ids = b.encode(text)
    starts, ends = b.char_offsets(text, ids)
    at = 0
    for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist()):
        raw = b.table[i]
        assert raw in text[s:e].encode() and e > s
        at += len(raw)
    cut = spark.createDataFrame([(bytes(b.decode(ids)[:3]),)], "decoded binary")
    assert cut.select(bytebpe.decoded_text()).first()[0] == "aé".encode()[:3].decode(errors="replace")


def test_op4_equals_tiktoken(spark, library):
    _, tik = library
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op4_byte_bpe(spark, SF_SMALL).collect():
        ids = tik.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


# -- packing --------------------------------------------------------------------
def _check_pieces(rows, capacity):
    """Every document's ids in exactly one piece; sequences without gaps and
    without padding (full, or a power of two)."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return docs


@pytest.mark.parametrize("capacity,pool", [(1024, 512), (16, 3)])
def test_packing_keeps_every_id(spark, library, capacity, pool):
    tok, _ = library
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3)
    docs = _check_pieces(packing.pack(src, capacity=capacity, pool_sequences=pool).collect(), capacity)
    for r in src.collect():
        own = sorted(docs.pop(r.doc_id), key=lambda p: p.start)
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert b"".join(bytes(p.ids) for p in own) == np.array(ids, "<u4").tobytes()
        assert {p.doc_tokens for p in own} == {len(ids)}
    assert not docs


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    _check_pieces(rows, 1024)
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2
    assert packing.pack(empty).count() == 0


def test_op2_crc(spark):
    for r, p in zip(sorted(queries.op2_cost_packing(spark, SF_SMALL).collect()),
                    sorted(packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
                           .select("doc_id", "start", "length", "ids").collect())):
        assert (r.doc_id, r.start, r.length) == p[:3] and r.ids_crc32 == zlib.crc32(bytes(p.ids))


def test_assignment_prefers_the_cheapest_sequence():
    out = packing.assign([(0, 0, 900), (1, 0, 500), (2, 0, 500), (3, 0, 148)], 1024)
    assert sorted(sum(n for _, _, n in s) for s in out) == [1024, 1024]
    by_doc = {d: i for i, s in enumerate(out) for d, _, _ in s}
    assert by_doc[1] == by_doc[2] != by_doc[0]  # the costly piece stands apart


# -- training order ---------------------------------------------------------------
def test_permutation_is_a_keyed_bijection():
    for n in [*range(1, 40), 1000, 4097]:
        slots = training_order.slot_of(np.arange(n), n, key=7)
        assert sorted(slots.tolist()) == list(range(n))
        assert training_order.index_of(slots, n, key=7).tolist() == list(range(n))
    assert training_order.slot_of(np.arange(500), 500, 1).tolist() != training_order.slot_of(np.arange(500), 500, 2).tolist()


def test_shards_hold_every_sequence_once_and_resume(spark, tmp_path, empty):
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = f"file://{tmp_path}/order"
    kw = dict(key=5, shard_slots=32, segments=3)
    manifest = training_order.materialise(src, out, **kw)
    rows = training_order.records(manifest, out, shard_slots=32).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    seqs = training_order.sequences(src).orderBy("part", "place").collect()
    want = training_order.index_of(np.arange(len(rows)), len(rows), 5)
    for r, i in zip(rows, want.tolist()):
        assert bytes(r.ids) == np.frombuffer(seqs[i].ids, "<u2").astype("<u4").tobytes()
    # reading goes on from any slot, across shards
    got = list(training_order.read_range(out, 20, 30, shard_slots=32))
    assert [s for s, _ in got] == list(range(20, min(50, len(rows))))
    assert all(ids.astype("<u4").tobytes() == bytes(rows[s].ids) for s, ids in got)
    before = sorted(manifest.collect())
    # a finished segment is not written again; a lost one is
    first, second = tmp_path / "order/manifest/segment-00000", tmp_path / "order/manifest/segment-00001"
    stamp = (first / "_SUCCESS").stat().st_mtime_ns
    (second / "_SUCCESS").unlink()
    again = training_order.materialise(src, out, **kw)
    assert sorted(again.collect()) == before
    assert (first / "_SUCCESS").stat().st_mtime_ns == stamp and (second / "_SUCCESS").exists()
    assert training_order.materialise(empty, f"file://{tmp_path}/none").count() == 0


def test_training_order_of_odd_rows(odd, tmp_path):
    out = f"file://{tmp_path}/odd"
    rows = training_order.records(training_order.materialise(odd, out), out).collect()
    b = bpe.encoder(JSON)
    assert sum(r.length for r in rows) == sum(len(b.encode(t or "")) + 1 for _, t in TEXTS)


# -- edits ------------------------------------------------------------------------
def test_counts_after_random_edits():
    b, rng = bpe.encoder(JSON), random.Random(9)
    texts = _random_texts(150, seed=4)
    for text in texts[:300]:
        leaves = token_counts.runs(text, 20)
        tree = token_counts.SegmentTree(leaves, [len(b.encode(x)) for x in leaves])
        for _ in range(4):
            start, deleted = rng.randint(0, len(text) + 3), rng.randint(0, 30)
            inserted = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
            tree.edit(b, start, deleted, inserted, 20)
            start = min(start, len(text))
            text = text[:start] + inserted + text[start + deleted:]
            assert "".join(tree.leaves) == text
            assert (tree.n_chars, tree.n_tokens) == (len(text), len(b.encode(text)))


def _edited(text, edits):
    for e in edits:
        if e is not None and None not in e:
            start = min(max(e[0], 0), len(text))
            text = text[:start] + e[2] + text[start + max(e[1], 0):]
    return text


def test_op1_equals_encoding_the_edited_text(spark):
    b = bpe.encoder(JSON)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", "text", token_counts.demo_edits().alias("edits")).collect()
    got = {r.doc_id: r for r in queries.op1_edit_token_counts(spark, SF_SMALL).collect()}
    for r in docs:
        text = _edited(r.text or "", r.edits)
        q = got[r.doc_id]
        assert (q.tokens_before, q.tokens_after) == (len(b.encode(r.text or "")), len(b.encode(text)))
        assert (q.chars_before, q.chars_after) == (len(r.text or ""), len(text))


def test_edits_of_odd_rows(odd, empty):
    edit = F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.array(
        F.struct(F.lit(2).cast("long").alias("start"), F.lit(3).cast("long").alias("deleted"), F.lit(" new\n").alias("inserted")),
        F.struct(F.lit(None).cast("long").alias("start"), F.lit(1).cast("long").alias("deleted"), F.lit("x").alias("inserted")),
        F.lit(None), F.struct(F.lit(-4).cast("long").alias("start"), F.lit(10**6).cast("long").alias("deleted"),
                              F.lit("end ").alias("inserted"))))
    rows = token_counts.apply_edits(token_counts.build_trees(odd.withColumn("edits", edit)), with_text=True).collect()
    b = bpe.encoder(JSON)
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.tokens_after == len(b.encode(r.text)) == sum(r.leaf_tokens) and r.chars_after == len(r.text)
        assert r.text == "one two" if r.doc_id == 5 else r.text == "end "
    made = token_counts.build_trees(empty.withColumn("edits", token_counts.demo_edits(tag="text")))
    assert token_counts.apply_edits(made).count() == 0


@pytest.mark.parametrize("capacity", [8, bpe.CACHE_TOKENS])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_several_texts_at_once_equal_one_by_one(name, capacity):
    """Pre-tokens learnt for many texts, through both generations of the table."""
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in TEXTS] + ["The cat, the dog.", "the dog's 12 cats", "", "naïve café", "ab " * 400]
    many, one = bpe.ByteBpe(path, capacity), bpe.ByteBpe(path)
    for at in range(0, len(texts), 3):
        for text, ids in zip(texts[at:at + 3], many.encode_many(texts[at:at + 3])):
            assert ids.tolist() == one.encode(text).tolist() == many.encode(text).tolist()
            assert many.decode(ids) == text.encode()
    assert len(many.known) <= capacity
