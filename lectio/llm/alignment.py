"""Links between two tokenizers' tokens by sparse incidence products.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library, tokenizer B
a ``sentencepiece`` model.  A encodes blank + text and B the text, to which B
adds that blank itself, so both cover the same bytes.  Bytes where a token of A
and a token of B both end cut the tokens into groups.

*Matrices.*  Incidence matrices are kept in CSR form, built by hand: token by
byte for each tokenizer, and token id by group.  Gustavson's row product of A's
byte matrix with B's transposed one gives the overlap links (tokens that share
bytes), that of the group matrices the shared-group links: how often each pair
of ids lies in one group.  A third product, of documents by units with units by
pairs, gives each document's links.

*Units.*  Both tokenizers end a token wherever a character that is no white
space precedes a blank or a line feed, and what follows does not depend on what
precedes (B's pieces hold a blank mark only at their start and never a line
feed; checked when the model is loaded).  In plain Latin text they also end one
between a letter or digit and a full stop or comma.  So a text falls into units,
white space with the word after it, and equal units have equal tokens and links.
A worker keeps the most used units in a bounded table; a unit that is not there
is encoded and multiplied again, so the table only saves work.

*Counts.*  How many documents hold a pair is counted over the whole corpus, and
joined back to the documents' pairs; a lookup table beyond the broadcast bound
takes a shuffle instead.

Null and empty texts, and texts whose tokens of A or B do not spell blank + text
(a text may hold the mark that B reads as a blank), have no tokens.  Every row
is a document of its own, whatever its id.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.bpe import ByteBpe
from lectio.llm.common import stage, text_or_empty
from lectio.llm.substring import _by_slices
from lectio.operators.joins import lookup_join

#: Units that keep their tokens of A when they follow each other.
WORD_UNIT = re.compile(r"[ \n][A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u027f]+")
#: Units that a worker keeps (about 500 bytes each).
KNOWN_UNITS = 200_000
#: Entries that one step of a product expands.
EXPAND = 1 << 18
#: Texts that are taken together.
SLICE_BYTES = 1 << 21
BLANK = "▁"


# -- units ----------------------------------------------------------------------------
def _byte_kinds() -> np.ndarray:
    """For every byte: 0 of letters and digits below U+0280, 1 blank and line
    feed, 2 other ASCII signs, 3 full stop and comma, 4 the rest (other white
    space and controls, U+0080-U+00BF, characters from U+0280)."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 2
    for a, b in ((48, 58), (65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xCA)):
        kinds[a:b] = 0
    kinds[[32, 10]], kinds[[44, 46]] = 1, 3
    return kinds


_KINDS = _byte_kinds()


def units_of(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of units of each blank + text (none of an empty text), and
    all units in order.  A text is plain if it holds nothing but kinds 0 to 3,
    no full stop or comma after another sign, and no multiplication or division
    sign; any other is cut only between a printable ASCII character and a blank
    or line feed."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    data = b"".join(raw)
    b = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    if not len(b):
        return np.zeros(len(texts), np.int64), pa.array([], pa.string()).dictionary_encode()
    kind = _KINDS[b]
    dot, before = kind == 3, np.append(np.uint8(4), kind[:-1])
    odd = (kind == 4) | dot & (before == 2)
    odd[1:] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))
    plain = np.ones(len(texts), bool)
    plain[np.searchsorted(ends, np.flatnonzero(odd), side="right")] = False
    wide = np.repeat(plain, [len(r) for r in raw])
    cut = (kind == 1) & ((before == 0) | (before == 2) | (before == 3))
    cut[1:] &= wide[1:] | (b[:-1] < 0x80)
    cut |= wide & dot & (before == 0)
    starts = np.concatenate([[0], ends[:-1]])
    cut[starts[starts < ends]] = True
    at = np.flatnonzero(cut).astype(np.int32)
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, np.int32(len(b)))), pa.py_buffer(data))
    return counts, units.dictionary_encode()


# -- sparse matrices ----------------------------------------------------------------
@dataclass
class Csr:
    """A sparse matrix: row i holds ``data[at]`` in column ``cols[at]`` for
    ``at`` from ``ptr[i]`` up to ``ptr[i + 1]``."""
    ptr: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def csr(rows: np.ndarray, cols: np.ndarray, data: np.ndarray, shape: tuple[int, int]) -> Csr:
    """From entries in any order; entries of one place add up."""
    place = rows.astype(np.int64) * shape[1] + cols
    place, which = np.unique(place, return_inverse=True)
    total = np.bincount(which, weights=data, minlength=len(place)).astype(np.int64)
    row, col = np.divmod(place, max(shape[1], 1))
    return Csr(np.searchsorted(row, np.arange(shape[0] + 1)), col, total, shape[1])


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.cols, kind="stable")
    return Csr(np.searchsorted(m.cols[order], np.arange(m.width + 1)), m.rows[order], m.data[order], len(m.ptr) - 1)


def gustavson(a: Csr, b: Csr, expand: int = EXPAND) -> Csr:
    """A times B, row by row: each entry (i, k) of A adds row k of B, times
    its value, to row i.  Rows are taken together in steps that expand about
    ``expand`` entries."""
    fan = b.ptr[a.cols + 1] - b.ptr[a.cols]  # entries that each entry of A expands to
    upto = np.concatenate([[0], np.cumsum(fan)])[a.ptr]
    parts, start, n = [], 0, len(a.ptr) - 1
    while start < n:
        end = max(int(np.searchsorted(upto, upto[start] + expand, side="right")) - 1, start + 1)
        at = np.arange(a.ptr[start], a.ptr[end])
        count = fan[at]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        source = np.repeat(b.ptr[a.cols[at]], count) + inner
        row = np.repeat(np.repeat(np.arange(end - start), np.diff(a.ptr[start:end + 1])), count)
        parts.append(csr(row, b.cols[source], np.repeat(a.data[at], count) * b.data[source], (end - start, b.width)))
        start = end
    if not parts:
        return Csr(np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), b.width)
    shift = np.cumsum([0] + [len(p.cols) for p in parts])
    return Csr(np.concatenate([p.ptr[:-1] + s for p, s in zip(parts, shift)] + [shift[-1:]]),
               np.concatenate([p.cols for p in parts]), np.concatenate([p.data for p in parts]), b.width)


def stacked(a: Csr, b: Csr) -> Csr:
    """The rows of A, then those of B."""
    return Csr(np.concatenate([a.ptr, b.ptr[1:] + a.ptr[-1]]), np.concatenate([a.cols, b.cols]),
               np.concatenate([a.data, b.data]), max(a.width, b.width))


def incidence(lengths: np.ndarray) -> Csr:
    """Token by byte, for tokens that follow each other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(total), np.ones(total, np.int64), total)


# -- tokenizers -----------------------------------------------------------------------
class PieceModel:
    """Tokenizer B: pieces and their bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("pieces must not go on after a blank or hold a line feed")
        if any(re.search("[A-Za-z0-9\xc0-\u027f][.,]", p) for p in pieces if len(p) > 1):
            raise ValueError("pieces must not go on from a letter or digit to a full stop or comma")
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                      else b"" if self.model.is_control(i) or self.model.is_unknown(i)
                      else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of units.  The model's own blank stands for a unit's first
        one.  Nothing merges over a line feed, so a unit without a blank (or a
        blank alone) is encoded behind one, and the tokens before it are
        dropped."""
        drop = [0 if u[0] == " " and len(u) > 1 else 1 if u[0] == "\n" else 2 for u in units]
        found = self.model.encode([("", "", "\n")[d] + u[d == 0:] for u, d in zip(units, drop)], num_threads=1)
        return [ids[d:] if d else ids for ids, d in zip(found, drop)]


def rank_encoder(path: str, table: list[bytes]) -> tiktoken.Encoding | None:
    """A faster encoder of plain words, if the vocabulary's ids follow the
    order of its merges; their tokens are then the same."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    special = {t["id"] for t in spec.get("added_tokens", [])}
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    ranks = {t: i for i, t in enumerate(table) if i not in special}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spelled(units: pa.Array, ids: np.ndarray, unit: np.ndarray, table: pa.Array) -> np.ndarray:
    """Which units the tokens spell byte for byte."""
    have = strings(table, ids, np.searchsorted(unit, np.arange(len(units) + 1)))
    return np.array(pa.compute.equal(have, units).to_numpy(zero_copy_only=False), bool)


def strings(parts: pa.Array, codes: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``parts`` at ``codes``, joined from each cut up to the next."""
    taken = parts.take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[:len(codes) + 1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1,
                                       [None, pa.py_buffer(offsets[cuts].copy()), taken.buffers()[2]])


class Aligner:
    """Units with their tokens and links, as one worker knows them.

    ``known`` numbers the units; ``texts`` (their groups), ``counts`` (columns
    n_a, n_b, n_groups, n_links, n_overlaps, misspelled), ``uses`` and the rows
    of ``links`` (unit by link, the pair itself as the column) are in that
    order."""

    def __init__(self, path_a: str, path_b: str, capacity: int = KNOWN_UNITS):
        self.a, self.b, self.capacity = ByteBpe(path_a, capacity=0), PieceModel(path_b), capacity
        self.bytes_a, self.bytes_b = (pa.array(t, pa.binary()) for t in (self.a.table, self.b.table))
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.a.table, self.b.table))
        self.words = rank_encoder(path_a, self.a.table)
        # a token's text with the sign after it: A goes on, A ends, B goes on, B ends
        self.signs = pa.array([f"{i}{sign}" for size, sign in (
            (self.a.size, ","), (self.a.size, "|"), (len(self.b.table), ","), (len(self.b.table), ";"))
            for i in range(size)], pa.string()).cast(pa.binary())
        none = np.empty(0, np.int64)
        self.known: dict[str, int] = {}
        self.texts = pa.array([], pa.binary())
        self.counts, self.uses = np.zeros((0, 6), np.int64), none
        self.links = Csr(np.zeros(1, np.int64), none, none, 0)

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of units, and each id's unit.  Plain words are encoded as
        one text, in which tokens end where they do."""
        alone = np.array([self.words is not None and WORD_UNIT.fullmatch(u) is not None for u in units], bool)
        words, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
        ids, unit = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(words):
            joined = [units[i] for i in words]
            ids.append(np.array(self.words.encode_ordinary("".join(joined)), np.int64))
            ends = np.cumsum([len(u.encode()) for u in joined])
            unit.append(words[np.searchsorted(ends, np.cumsum(self.length_a[ids[-1]]))])
        if len(rest):
            enc = self.a.tok.encode([units[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(enc.ids, np.int64))
            unit.append(rest[np.array(enc.word_ids, np.int64)])
        ids, unit = np.concatenate(ids), np.concatenate(unit)
        order = np.argsort(unit, kind="stable")
        return ids[order], unit[order]

    def learn(self, units: list[str]) -> None:
        """Tokens, groups and links of units, all in one go."""
        n, size_b = len(units), len(self.b.table)
        a, unit_a = self._encode_a(units)
        lists = self.b.encode(units)
        b = np.array([i for ids in lists for i in ids], np.int64)
        unit_b = np.repeat(np.arange(n), [len(x) for x in lists])
        raw = pa.array(units, pa.string()).cast(pa.binary())
        good = spelled(raw, a, unit_a, self.bytes_a) & spelled(raw, b, unit_b, self.bytes_b)
        if not good.all():
            a, unit_a = a[good[unit_a]], unit_a[good[unit_a]]
            b, unit_b = b[good[unit_b]], unit_b[good[unit_b]]

        bytes_a, bytes_b = incidence(self.length_a[a]), incidence(self.length_b[b])
        overlaps = gustavson(bytes_a, transposed(bytes_b))
        # both tokenizers cover the same bytes: common ends cut the groups
        ends = np.intersect1d(bytes_a.ptr[1:], bytes_b.ptr[1:], assume_unique=True)
        group_a, group_b = np.searchsorted(ends, bytes_a.ptr[1:]), np.searchsorted(ends, bytes_b.ptr[1:])
        unit_of = np.zeros(len(ends), np.int64)
        unit_of[group_a] = unit_a

        # shared-group links: rows are the (unit, id of A) pairs, columns the ids of B
        rows, which = np.unique(unit_a * self.a.size + a, return_inverse=True)
        of_a = csr(which, group_a, np.ones(len(a)), (len(rows), len(ends)))
        of_b = csr(group_b, b, np.ones(len(b)), (len(ends), size_b))
        made = gustavson(of_a, of_b)
        row = rows[made.rows]
        unit, pair = row // self.a.size, ((row % self.a.size) << 32) | made.cols
        fresh = Csr(np.searchsorted(unit, np.arange(n + 1)), pair, made.data, 0)
        self.links = stacked(self.links, fresh)
        sums = [np.bincount(x, minlength=n) for x in (unit_a, unit_b, unit_of)]
        sums += [np.bincount(x, weights=w, minlength=n).astype(np.int64)
                 for x, w in ((unit, made.data), (unit_a, np.diff(overlaps.ptr)))]
        self.counts = np.concatenate([self.counts, np.stack([*sums, ~good], axis=1)])
        self.uses = np.concatenate([self.uses, np.zeros(n, np.int64)])
        texts = self._group_texts(a, group_a, b, group_b, np.searchsorted(unit_of, np.arange(n + 1)))
        self.texts = pa.concat_arrays([self.texts, texts])
        self.known.update(zip(units, range(len(self.known), len(self.known) + n)))

    def _group_texts(self, a, group_a, b, group_b, cuts) -> pa.Array:
        """Each unit's groups as text; ``cuts`` are the units' first groups."""
        size_a, size_b = self.a.size, len(self.b.table)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (group_a, group_b))
        code = np.concatenate([a + size_a * last_a, 2 * size_a + b + size_b * last_b])
        place = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        return strings(self.signs, code[order], np.searchsorted(place[order], 2 * cuts))

    def _forget(self) -> None:
        """Keep the most used half of the table."""
        if len(self.known) <= self.capacity:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:self.capacity // 2])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.texts = self.texts.take(pa.array(keep))
        self.counts, self.uses = self.counts[keep], self.uses[keep] // 2
        count = np.diff(self.links.ptr)[keep]
        at = np.repeat(self.links.ptr[keep] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        self.links = Csr(np.concatenate([[0], np.cumsum(count)]), self.links.cols[at], self.links.data[at], 0)

    def documents(self, texts: list[str]):
        """For each text its counts, the digest of its groups, and its links:
        row bounds, pairs and how often each."""
        self._forget()
        lengths, units = units_of(texts)
        names = units.dictionary.to_pylist()
        fresh = [u for u in names if u not in self.known]
        if fresh:
            self.learn(fresh)
        number = np.array([self.known[u] for u in names], np.int64)
        unit = number[units.indices.to_numpy()]
        self.uses += np.bincount(unit, minlength=len(self.uses))
        held = csr(np.repeat(np.arange(len(texts)), lengths), unit, np.ones(len(unit)), (len(texts), len(self.uses)))
        sums = np.zeros((len(texts), 6), np.int64)
        some = np.flatnonzero(lengths)
        if len(some):
            sums[some] = np.add.reduceat(self.counts[held.cols] * held.data[:, None], held.ptr[some])
        bad = sums[:, 5] > 0
        sums[bad] = 0
        pairs, place = np.unique(self.links.cols, return_inverse=True)
        held.data = np.where(bad[held.rows], 0, held.data)
        links = gustavson(held, Csr(self.links.ptr, place, self.links.data, len(pairs)))
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        groups = strings(self.texts, unit, cuts)
        digests = [hashlib.sha256(memoryview(g.as_buffer())[:-1]).hexdigest() if s else ""
                   for s, g in zip(sums[:, 0].tolist(), groups)]
        real = np.flatnonzero(links.data)  # a misspelled text has none
        ptr = np.searchsorted(links.rows[real], np.arange(len(texts) + 1))
        return sums[:, :5], digests, ptr, pairs[links.cols[real]], links.data[real]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# -- the operator -------------------------------------------------------------------------
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
LINK = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])


def document_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's tokens, groups and links: ``id_col``, n_a, n_b, n_groups,
    n_links, n_overlaps (pairs of tokens that share bytes), groups_sha256 and
    links (array of pair, A's id in the high and B's in the low 32 bits, and
    n, how often)."""
    src = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(LINK))])

    def run(it):
        for rows in _by_slices(it, SLICE_BYTES):
            sums, digests, ptr, pairs, n = aligner(path_a, path_b).documents([r[1] for r in rows])
            links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *[pa.array(c) for c in sums.T.copy()],
                 pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), links)], schema.names)

    return src.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, held, best)``: how many documents hold a pair, and whether no
    pair of its A id is held by more.  An A id has at most as many pairs as B
    has ids, so its window is bounded."""
    held = links.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
    highest = F.max("held").over(Window.partitionBy(F.shiftright("pair", 32)))
    return held.withColumn("best", F.col("held") == highest)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_a, n_b, n_groups, n_links,
    n_overlaps, n_best (links whose pair is held by most documents among its A
    id's pairs), count_sum (documents that hold the pair, summed over the
    links) and groups_sha256."""
    found = stage(document_links(docs, path_a, path_b, id_col, text_col)
                  .withColumn("_row", F.monotonically_increasing_id()), "alignment-links")
    counts = stage(pair_counts(found), "alignment-counts")
    each = found.select("_row", F.inline("links"))
    sums = lookup_join(each, counts, "pair", "inner").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("held")).alias("count_sum"))
    return found.drop("links").join(sums, "_row", "left").select(
        id_col, *COUNTS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
