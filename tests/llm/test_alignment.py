"""Token alignment against the two libraries, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectio.llm import alignment as al
from lectio.llm.bpe import byte_alphabet
from tests.conftest import SF_SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SIGNS = [" ", "  ", "\n", "\t", "a", "b", "é", "ß", ".", ",", "1", "²", "中", "😀", "\r", "\x1c", "\xa0", "'s", "_", "-", "the",
         " of", "<s>", "<|endoftext|>", "\x00", "½", "×", "A", "ﬁ"]


@pytest.fixture(scope="module")
def brute():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = byte_alphabet()

    def tokens(text):
        a = tok.encode(" " + text, add_special_tokens=False).ids
        raw_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
        b = model.encode(text)
        names = [model.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
        return a, raw_a, b, raw_b

    def one(text):
        none = (0, 0, 0, 0, 0), "", Counter()
        if not text:
            return none
        a, raw_a, b, raw_b = tokens(text)
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return none
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, start = [], Counter(), 0
        for end in cuts:
            ga = [i for i, e in zip(a, ends_a) if start < e <= end]
            gb = [i for i, e in zip(b, ends_b) if start < e <= end]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.update((x << 32) | y for x in ga for y in gb)
            start = end
        spans_a = list(zip([0, *ends_a], ends_a))
        overlaps = sum(max(s, t) < min(e, f) for s, e in spans_a for t, f in zip([0, *ends_b], ends_b))
        counts = len(a), len(b), len(cuts), sum(links.values()), overlaps
        return counts, hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return one


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choices(SIGNS, k=rng.randint(0, 24))) for _ in range(1500)]
    words = ["the", "house,", "of", "naïve.", "Straße", "3.14", "a,b", "it's", "x", "\n", "U.S.A.", "₂", "»quoted«", "foo…"]
    out += [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    return out + ["", None, " ", "  ", "\n", "a▁b and more", "▁", "x" * 3000, "ab " * 800]


@pytest.mark.parametrize("capacity", [20, al.KNOWN_UNITS])
def test_documents_equal_the_libraries(brute, capacity):
    aligner, every = al.Aligner(A, B, capacity), [t or "" for t in texts()]
    for at in range(0, len(every), 300):
        part = every[at:at + 300]
        sums, digests, ptr, pairs, n = aligner.documents(part)
        for i, text in enumerate(part):
            got = tuple(sums[i].tolist()), digests[i], Counter(dict(zip(pairs[ptr[i]:ptr[i + 1]].tolist(), n[ptr[i]:ptr[i + 1]].tolist())))
            assert got == brute(text), repr(text)


def test_query_counts(spark, brute, odd, empty):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts()[-40:])] + [(None, "of the house")] * 2,
                                  "doc_id long, text string")
    df = docs.union(extra)
    rows = [(r.doc_id, *brute(r.text)) for r in df.collect()]
    held = Counter(p for *_, links in rows for p in links)
    best = defaultdict(int)
    for p, c in held.items():
        best[p >> 32] = max(best[p >> 32], c)
    want = [(i, *counts, sum(n for p, n in links.items() if held[p] == best[p >> 32]),
             sum(n * held[p] for p, n in links.items()), digest) for i, counts, digest, links in rows]
    got = [tuple(r) for r in al.align(df, A, B).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert al.align(empty, A, B).count() == 0
    assert al.align(odd, A, B).count() == odd.count()


def test_gustavson_equals_dense():
    rng = np.random.default_rng(1)
    for expand in (1, 7, 1 << 18):
        a, b = (rng.integers(0, 3, (9, 12)) * (rng.random((9, 12)) < 0.3) for _ in range(2))
        x = al.csr(*np.nonzero(a), a[np.nonzero(a)], a.shape)
        y = al.transposed(al.csr(*np.nonzero(b), b[np.nonzero(b)], b.shape))
        z = al.gustavson(x, y, expand)
        dense = np.zeros((9, 9), int)
        dense[z.rows, z.cols] = z.data
        assert (dense == a @ b.T).all()
