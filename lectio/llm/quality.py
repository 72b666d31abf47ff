"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad, or no vote.  Nobody
says how good they are: expectation-maximisation over the counts of vote
patterns estimates each labeller's votes given the class, and the share of good
documents.  The posterior of a pattern is the label of its documents, and these
labels train a linear scorer on hashed words and word shapes, which decides.

Patterns are few (three to the number of labellers), so their counts may go to
the driver at any size.  The scorer is fitted on at most ``TRAIN_DOCS``
documents, chosen by a hash of the id; votes, pattern counts and scores cover
every document and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.common import free_memory, make_room, text_or_empty
from lectio.llm.spotsigs import ANCHORS
from lectio.llm.substring import _by_slices
from lectio.llm.wordhash import batch_hashes, word_hashes

#: Labelled documents that the scorer is fitted on, at most about.
TRAIN_DOCS = 8_000
#: Hash slots of words; word shapes have as many of their own.
SLOTS = 1 << 14
#: Documents below this score are rejected.
THRESHOLD = 0.5
#: A labeller is taken to call at most this share of good documents bad.
#: Without a bound, the two classes may part along one kind of bad documents.
MAX_FALSE_ALARM = 0.02
BAD, GOOD, NONE = 0, 1, 2


@dataclass(frozen=True)
class Labeller:
    """Votes on a measure: bad outside ``fair``, good inside ``fine``, no
    vote between them or with fewer words than ``least``."""

    measure: str
    fair: tuple[float, float]
    fine: tuple[float, float]
    least: int = 1

    def votes(self, m: dict[str, np.ndarray]) -> np.ndarray:
        x = m[self.measure]
        out = np.full(len(x), NONE, np.int64)
        out[(x >= self.fine[0]) & (x <= self.fine[1])] = GOOD
        out[(x < self.fair[0]) | (x > self.fair[1])] = BAD
        out[m["words"] < self.least] = NONE
        return out


LABELLERS = (
    Labeller("symbols", (0, 0.08), (0, 0.02)),
    Labeller("repeats", (0, 0.2), (0, 0.05), 20),
    Labeller("variety", (0.5, np.inf), (0.8, np.inf), 50),
    Labeller("capitals", (0, 0.5), (0, 0.15)),
    Labeller("common", (0.05, 1), (0.15, 0.75), 10),
    Labeller("length", (2, 14), (3, 10)),
    Labeller("shouts", (0, 0.3), (0, 0.05)),
    Labeller("stops", (0.01, 0.6), (0.02, 0.3), 30),
)

# Classes of bytes; those of multi-byte characters count as letters.
_LETTER, _CAPITAL, _DIGIT, _SPACE, _STOP, _SHOUT, _MARK, _SYMBOL = range(8)
_CLASS = np.full(256, _SYMBOL, np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LETTER), (bytes(range(128, 256)), _LETTER),
                      (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CAPITAL), (b"0123456789", _DIGIT),
                      (b" \t\n\x0b\x0c\r", _SPACE), (b".?", _STOP), (b"!", _SHOUT), (b",;:'\"()-", _MARK)):
    _CLASS[list(_chars)] = _kind
#: Word shapes: letters, capitals and digits each as one sign.
_SHAPE = bytes(b"a"[0] if c == _LETTER else b"A"[0] if c == _CAPITAL else b"0"[0] if c == _DIGIT else i
               for i, c in enumerate(_CLASS))
_COMMON = np.unique(word_hashes(" ".join(ANCHORS.values()).encode()))


def measures(texts: list[bytes], h: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of texts whose lower-cased words have hashes ``h``."""
    kinds = np.zeros((len(texts), 8), np.int64)
    for i, t in enumerate(texts):
        kinds[i] = np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=8)
    words = np.diff(np.concatenate([[0], ends]))
    distinct = np.array([len(np.unique(h[e - n:e])) for e, n in zip(ends.tolist(), words.tolist())], np.float64)
    doc = np.repeat(np.arange(len(texts)), words)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.empty(0, np.int64)
    per_word = np.maximum(words, 1)
    letters = kinds[:, _LETTER] + kinds[:, _CAPITAL]
    solid = np.maximum(kinds.sum(axis=1) - kinds[:, _SPACE], 1)
    return {
        "words": words,
        "symbols": kinds[:, _SYMBOL] / solid,
        "repeats": np.bincount(doc[same], minlength=len(texts)) / per_word,
        "variety": distinct / per_word ** 0.8,  # distinct words grow more slowly than the text
        "capitals": kinds[:, _CAPITAL] / np.maximum(letters, 1),
        "common": np.bincount(doc[np.isin(h, _COMMON)], minlength=len(texts)) / per_word,
        "length": letters / per_word,
        "shouts": kinds[:, _SHOUT] / per_word,
        "stops": (kinds[:, _STOP] + kinds[:, _SHOUT]) / per_word,
    }


def patterns(texts: list[bytes], labellers: tuple[Labeller, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vote patterns (base 3), and the word hashes and ends they rest on."""
    h, ends = batch_hashes([t.lower() for t in texts])
    m = measures(texts, h, ends)
    code = np.zeros(len(texts), np.int64)
    for lab in labellers:
        code = code * 3 + lab.votes(m)
    return code, h, ends


def unpack(codes: np.ndarray, n: int) -> np.ndarray:
    """Votes (patterns x labellers) of pattern codes."""
    return np.stack([(codes // 3 ** (n - 1 - i)) % 3 for i in range(n)], axis=1)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 500,
                             tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's vote shares given
    the class (labellers x classes x bad or good), and the share of good
    documents.  No vote tells nothing: it depends on a text's length.

    Starts from labellers that call a bad document bad more often than a good
    one, which also fixes what the classes mean.
    """
    n = votes.shape[1]
    shares = np.tile(np.array([[0.5, 0.5], [0.05, 0.95]]), (n, 1, 1))
    good = 0.8
    posterior = np.full(len(votes), good)
    for _ in range(rounds):
        logs = np.tile(np.log(np.array([1 - good, good])), (len(votes), 1))
        for i in range(n):
            voted = votes[:, i] != NONE
            logs[voted] += np.log(shares[i])[:, votes[voted, i]].T
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([1 - now, now], axis=1) * counts[:, None]
        total = weight.sum(axis=0)
        good = float((total[1] + 1) / (total.sum() + 2))
        for i in range(n):
            cast = np.stack([weight[votes[:, i] == v].sum(axis=0) for v in (BAD, GOOD)], axis=1) + 0.1
            cast /= cast.sum(axis=1, keepdims=True)
            alarm = min(cast[1, BAD], MAX_FALSE_ALARM)
            shares[i] = cast[0], (alarm, 1 - alarm)
        done = np.max(np.abs(now - posterior), initial=0) < tolerance
        posterior = now
        if done:
            break
    return posterior, shares, good


def slots(texts: list[bytes], h: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the words and of their shapes; a word that repeats the
    one before it has a shape of its own."""
    shapes, _ = batch_hashes([t.translate(_SHAPE) for t in texts])
    again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    shapes = np.where(again, np.uint64(0), shapes)
    top = np.uint64(n_slots - 1)
    return (h & top).astype(np.int64), (shapes & top).astype(np.int64) + n_slots


def fit(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, size: int, steps: int = 300,
        rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets by full-batch Adam on sparse
    rows (document, slot, value)."""
    w, b = np.zeros(size), 0.0
    m1, m2, c1, c2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    n = max(len(target), 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, value * w[slot], minlength=len(target)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        g, gb = np.bincount(slot, value * error[doc], minlength=size) + decay * w, float(error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        a, q = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= rate * (m1 / a) / (np.sqrt(m2 / q) + 1e-8)
        b -= rate * (c1 / a) / (np.sqrt(c2 / q) + 1e-8)
    return w, b


@dataclass
class Scorer:
    """What was learnt: posterior by pattern, weights and bias."""

    posterior: dict[int, float]
    shares: np.ndarray
    good: float
    weights: np.ndarray
    bias: float
    n_slots: int

    def scores(self, texts: list[bytes], h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """0 to 1 for each text; a text without words scores 0."""
        word, shape = slots(texts, h, self.n_slots)
        count = np.diff(np.concatenate([[0], ends]))
        doc = np.repeat(np.arange(len(texts)), count)
        total = np.bincount(doc, self.weights[word] + self.weights[shape], minlength=len(texts))
        z = total / np.maximum(count, 1) + self.bias
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))


def train(docs: DataFrame, labellers: tuple[Labeller, ...] = LABELLERS, train_docs: int = TRAIN_DOCS,
          n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit labeller accuracies on all documents and the scorer on at most
    about ``train_docs`` of them.  An empty table gives a scorer that accepts
    every text with words."""
    src = _source(docs, id_col, text_col)

    def vote(it):
        for rows in _by_slices(it):
            codes, _, _ = patterns([t.encode() for _, t in rows], labellers)
            kinds, counts = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts)], ["pattern", "n"])

    schema = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("n", T.LongType())])
    found = src.mapInArrow(vote, schema).groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes, counts = (np.array([r[i] for r in found], np.int64) for i in range(2))
    posterior, shares, good = expectation_maximisation(unpack(codes, len(labellers)), counts)
    labels = dict(zip(codes.tolist(), posterior.tolist()))

    share = max(1, -(-int(counts.sum()) // train_docs))
    sample = src.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)

    def features(it):
        for rows in _by_slices(it):
            texts = [t.encode() for _, t in rows]
            codes, h, ends = patterns(texts, labellers)
            word, shape = slots(texts, h, n_slots)
            start = 0
            out = []
            for code, end in zip(codes.tolist(), ends.tolist()):
                s, c = np.unique(np.concatenate([word[start:end], shape[start:end]]), return_counts=True)
                out.append((code, s.astype("<u4").tobytes(), (c / max(end - start, 1)).astype("<f4").tobytes()))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["pattern", "slots", "values"])

    schema = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("slots", T.BinaryType()),
                           T.StructField("values", T.BinaryType())])
    rows = sample.mapInArrow(features, schema).collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    slot = [np.frombuffer(r[1], "<u4") for r in rows]
    none = np.empty(0)
    w, b = fit(np.repeat(np.arange(len(rows)), [len(s) for s in slot]),
               np.concatenate([none, *slot]).astype(np.int64),
               np.concatenate([none, *[np.frombuffer(r[2], "<f4") for r in rows]]),
               np.array([labels[r[0]] for r in rows]), 2 * n_slots)
    return Scorer(labels, shares, good, w, b, n_slots)


def score(docs: DataFrame, scorer: Scorer, labellers: tuple[Labeller, ...] = LABELLERS,
          threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: ``id_col``, votes (one sign per labeller: b, g or -),
    posterior of good by the votes, score, kept.

    Null and empty texts score 0 and are not kept.  Other columns are not
    read; null and repeated ids are carried as they are.
    """
    src = _source(docs, id_col, text_col)
    key = T.StructField(id_col, src.schema["id"].dataType)
    schema = T.StructType([key, T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()),
                           T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    n = len(labellers)

    def run(it):
        signs = np.array(["b", "g", "-"])
        for rows in _by_slices(it):
            texts = [t.encode() for _, t in rows]
            codes, h, ends = patterns(texts, labellers)
            value = scorer.scores(texts, h, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array(["".join(v) for v in signs[unpack(codes, n)]]),
                 pa.array([scorer.posterior.get(c, scorer.good) for c in codes.tolist()]), pa.array(value),
                 pa.array(value >= threshold)], schema.names)

    return src.mapInArrow(run, schema)


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that reach the threshold;
    texts are scored where they are read, so nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(it):
        make_room()
        for b in it:
            kept = np.zeros(b.num_rows, bool)
            start = size = 0
            texts: list[bytes] = []
            for i, t in enumerate(b.column(at)):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size >= 1 << 22 or i == b.num_rows - 1:
                    h, ends = batch_hashes([t.lower() for t in texts])
                    kept[start:i + 1] = scorer.scores(texts, h, ends) >= threshold
                    start, size, texts = i + 1, 0, []
            yield b.filter(pa.array(kept))
        free_memory()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labellers: tuple[Labeller, ...] = LABELLERS, train_docs: int = TRAIN_DOCS,
             n_slots: int = SLOTS, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """:func:`train` on the documents, then :func:`score` them."""
    scorer = train(docs, labellers, train_docs, n_slots, id_col, text_col)
    return score(docs, scorer, labellers, threshold, id_col, text_col)
