"""Cost-balanced packing of documents into training sequences.

A document is its ids followed by one end id.  Whole stretches of ``capacity``
tokens become sequences of their own.  The rest of each document joins a pool;
when a task's pool holds ``pool_sequences`` sequences' worth of tokens, its
pieces are assigned in descending length to the sequence with the lowest
estimated cost (linear plus quadratic in the piece's length: attention looks
within a document only) that still has room for all of it.  A piece that fits
nowhere is cut: it fills the roomiest sequence, and what is left is assigned
in its turn.

A pool opens exactly as many sequences as its tokens need, and the remainder
is dealt to sequences whose sizes are powers of two, which are not padded; so
no token of padding is left.

Tasks pack what they read: there is no shuffle, memory is bounded by the pool
and one document, and a task that is run again gives the same rows as long as
its input comes in the same order (files do).  Sequence ids hold the
partition's number in their high bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectio.llm.bpe import encoded, encoder
from lectio.llm.common import batches, text_or_empty

CAPACITY = 1024
#: Sequences that one pool fills (half a million tokens).
POOL_SEQUENCES = 512
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
DEFAULT_VOCAB = "byte_bpe_50k.json"

#: A piece: its document's number in the pool, first token, number of tokens.
Piece = tuple[int, int, int]


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def sequence_sizes(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sizes of the sequences for so many tokens: full ones, then the
    remainder as falling powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(tails: list[Piece], capacity: int = CAPACITY, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> list[list[Piece]]:
    """Descending pieces to the cheapest sequence with room."""
    room = np.array(sequence_sizes(sum(t[2] for t in tails), capacity), np.int64)
    spent = np.zeros(len(room))
    out: list[list[Piece]] = [[] for _ in room]
    heap = [(-n, doc, start) for doc, start, n in tails if n]
    heapq.heapify(heap)
    while heap:
        n, doc, start = heapq.heappop(heap)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            to, put = fits[np.argmin(spent[fits])], n
        else:
            to = np.argmax(room)
            put = int(room[to])
            heapq.heappush(heap, (put - n, doc, start + put))
        out[to].append((doc, start, put))
        room[to] -= put
        spent[to] += cost(put, linear, quadratic)
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
         pool_sequences: int = POOL_SEQUENCES, linear: float = LINEAR, quadratic: float = QUADRATIC,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone.  Null and repeated document ids
    are carried as they are; every row is a document of its own.
    """
    path = path or public_tokenizers.path(DEFAULT_VOCAB)
    src = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    key = src.schema[id_col]
    schema = T.StructType([key, *[T.StructField(c, T.LongType()) for c in ("start", "length")],
                           T.StructField("ids", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]])
    arrow = to_arrow_schema(schema)

    def run(it):
        bpe = encoder(path)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], bpe.dtype)

        def documents():
            for b, i, ids in encoded(bpe, it):
                yield b.column(0)[i].as_py(), np.concatenate([ids, end])

        rows = ((k, start, n, ids.astype("<u4").tobytes(), total, sequence, offset) for k, start, n, ids, total, sequence, offset
                in packed(documents(), base, capacity, pool_sequences, linear, quadratic))
        yield from batches(rows, arrow, weight=3)

    return src.mapInArrow(run, schema)


def packed(documents: Iterator[tuple], base: int, capacity: int, pool_sequences: int,
           linear: float, quadratic: float) -> Iterator[tuple]:
    """The rows of one task (ids as an array), in the order in which its pools
    fill."""
    sequence = base
    pool: list[tuple] = []  # document id, its tokens, first token of the tail, the tail's ids
    held = 0

    def flush():
        nonlocal sequence
        for pieces in assign([(i, 0, len(p[3])) for i, p in enumerate(pool)], capacity, linear, quadratic):
            offset = 0
            for i, start, n in pieces:
                k, total, first, ids = pool[i]
                yield k, first + start, n, ids[start:start + n], total, sequence, offset
                offset += n
            sequence += 1

    for k, ids in documents:
        whole = len(ids) - len(ids) % capacity
        for start in range(0, whole, capacity):
            yield k, start, capacity, ids[start:start + capacity], len(ids), sequence, 0
            sequence += 1
        if whole < len(ids):
            pool.append((k, len(ids), whole, ids[whole:]))
            held += len(ids) - whole
        if held >= capacity * pool_sequences:
            yield from flush()
            pool.clear()
            held = 0
    yield from flush()
