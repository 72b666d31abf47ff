"""Byte-level BPE over whole texts, one distinct pre-token at a time.

Byte-level BPE never merges across the matches of the splitting pattern
("pre-tokens"), so a text's ids are the concatenated ids of its pre-tokens.
A worker process encodes each distinct pre-token once with the ``tokenizers``
library and keeps the result in a bounded table; common words then cost one
look-up.  The table only saves work: it has two generations, and when the young
one is full it replaces the old one, so pre-tokens that come again stay and
others are encoded anew when they do.

The pre-tokens of a text made of ASCII and Latin letters are found by a plain
regular expression that agrees with the library's pattern on those
characters.  A text with any other character goes through the library's own
splitting, so results never depend on the shortcut.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from lectio.llm.common import free_memory, keep

#: Pre-tokens kept per worker process (about 200 bytes each).
CACHE_TOKENS = 500_000
#: Fewer unknown pre-tokens than these are learnt by a call with less around it.
FEW = 256
#: Characters of the texts that are encoded together.
SLICE_CHARS = 1 << 21
#: Longer texts are encoded in pieces of about this many characters.
PIECE_CHARS = 1 << 18

# Letters below U+02B0; with the digits these are all that the shortcut must
# tell from punctuation, because other characters take the library's path.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_SIMPLE = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
# Separators that only Python calls white space, numbers that are no digits,
# and everything beyond the Latin blocks.
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ʯ]")
_OTHER_LATIN = "\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe"
#: A pre-token always ends between a character that is no white space and a
#: blank or line feed, and what follows does not depend on what precedes.
BOUNDARY = re.compile(r"(?<=\S)[ \n]")


def needs_library(text: str) -> bool:
    """Whether a text has a character of ``_OTHER``; in Latin-1, where most
    texts end, a search for each of them is quicker."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _OTHER.search(text) is not None
    return any(map(text.__contains__, _OTHER_LATIN))


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's character for each byte, as character -> byte:
    printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cut a long text where a pre-token must end."""
    out, at = [], 0
    while len(text) - at > limit:
        m = BOUNDARY.search(text, at + limit)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int]) -> Tokenizer:
    """A ``tokenizers`` BPE model equal to a rank table: a pair merges at the
    rank of its concatenation, whichever two parts make it up."""
    char = {b: c for c, b in byte_alphabet().items()}
    name = {t: "".join(char[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = [(token[:i], token[i:]) for i in range(1, len(token))]
        merges += [(name[a], name[b]) for a, b in parts if a in ranks and b in ranks]
    tok = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok


class ByteBpe:
    """Encoder and decoder of one vocabulary file (``.json`` for the
    ``tokenizers`` library, ``.tiktoken`` for a rank table)."""

    def __init__(self, path: str, capacity: int = CACHE_TOKENS):
        self.exact = None
        if path.endswith(".json"):
            self.tok = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            special = {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}
            alphabet = byte_alphabet()
            table = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
            table |= special
        else:
            ranks = rank_table(path)
            self.tok = tokenizer_of_ranks(ranks)
            self.exact = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
            table = {r: t for t, r in ranks.items()}
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = max(table) + 1
        self.table = [table.get(i, b"") for i in range(self.size)]
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.capacity = capacity
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- encoding -----------------------------------------------------------
    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if len(text) <= PIECE_CHARS:
            return np.frombuffer(self._piece(text), self.dtype)
        return np.frombuffer(b"".join(map(self._piece, pieces(text))), self.dtype)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of several texts; the pre-tokens that none of them has
        taught yet are learnt in one call."""
        cut = [pieces(t) if len(t) > PIECE_CHARS else [t] for t in texts]
        words = [[None if needs_library(p) else _SIMPLE.findall(p) for p in parts] for parts in cut]
        # each distinct one is looked up once in the large table; the texts then use a small one
        table = dict.fromkeys(chain.from_iterable(w for own in words for w in own if w is not None))
        table = dict(zip(table, map(self.known.get, table)))
        fresh = {w for w, ids in table.items() if ids is None}
        if fresh:
            table.update(self._learn(fresh))
        ids_of = table.__getitem__
        out = []
        for parts, own in zip(cut, words):
            raw = [self._whole(p) if w is None else b"".join(map(ids_of, w)) for p, w in zip(parts, own)]
            out.append(np.frombuffer(raw[0] if len(raw) == 1 else b"".join(raw), self.dtype))
        return out

    def _piece(self, text: str) -> bytes:
        if needs_library(text):
            return self._whole(text)
        words = _SIMPLE.findall(text)
        parts = list(map(self.known.get, words))
        if None in parts:
            fresh = self._learn({w for w, p in zip(words, parts) if p is None})
            parts = [fresh[w] if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)

    def _whole(self, text: str) -> bytes:
        """Splitting and merging by the library.  For a rank table the
        result is held against the rank library's own: tables of Unicode
        classes may differ between the two in a new character."""
        ids = self.tok.encode(text, add_special_tokens=False).ids
        if self.exact is not None:
            want = self.exact.encode_ordinary(text)
            if want != ids:
                ids = want
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens that the young generation lacks."""
        fresh = {w: self.old[w] for w in words if w in self.old} if self.old else {}
        need = [w for w in words if w not in fresh] if fresh else list(words)
        if need:
            if len(need) < FEW:
                enc = self.tok.encode(need, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(enc.ids, self.dtype)
                at = np.searchsorted(np.array(enc.word_ids, np.int64), np.arange(1, len(need) + 1))
            else:  # a faster call that does not say where pre-tokens end; their bytes do
                enc = self.tok.encode_batch_fast([need], is_pretokenized=True, add_special_tokens=False)[0]
                ids = np.array(enc.ids, self.dtype)
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, need)), np.int64, len(need)))
                at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            raw = ids.tobytes()
            at = (np.concatenate([[0], at]) * self.dtype.itemsize).tolist()
            fresh.update(zip(need, map(raw.__getitem__, map(slice, at, at[1:]))))
            if self.exact is not None:
                for w in need:  # two equally ranked pairs that overlap may merge in another order
                    want = np.array(self.exact.encode_ordinary(w), self.dtype).tobytes()
                    if want != fresh[w]:
                        fresh[w] = want
        if len(self.known) + len(fresh) > self.capacity // 2:
            self.old, self.known = self.known, {}
        if len(fresh) <= self.capacity // 2:
            self.known.update(fresh)
        return fresh

    # -- decoding -----------------------------------------------------------
    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; a character's bytes may come from several
        ids, so text is made only from the joined bytes."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        lengths = np.fromiter((len(self.table[i]) for i in ids.tolist()), np.int64, len(ids))
        return np.cumsum(lengths)

    def char_offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each id touches; ids
        that split a character both report it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        ends = self.byte_ends(ids)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
        begun = np.minimum(starts + 1, len(raw))
        return leads[begun] - 1 if len(ids) else starts, leads[ends]


def encoded(bpe: ByteBpe, it, column: int = 1) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The ids of a text column's rows, slice by slice: batch, row, ids."""
    for b in it:
        texts = b.column(column).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < SLICE_CHARS:
                size += len(texts[end])
                end += 1
            for i, ids in enumerate(bpe.encode_many(texts[start:end]), start):
                yield b, i, ids
            start = end
    free_memory()


@lru_cache(maxsize=4)
def encoder(path: str, capacity: int = CACHE_TOKENS) -> ByteBpe:
    """One encoder per file and worker process; workers are reused, so what
    it has learnt serves later tasks, until one that needs no encoder starts."""
    return ByteBpe(path, capacity)


keep(encoder.cache_clear)
