"""Repeated spans by compaction of a word de Bruijn graph.

The edges of the graph are the windows of ``k`` consecutive words; an edge
leads from its first k-1 words to its last.  Consecutive windows that share a
minimizer (the smallest hash among their runs of ``ANCHOR`` words) follow each
other without a branch inside the document, so they compact to one path.  The
same words always have the same minimizer, so equal windows lie in paths of one
minimizer, whatever surrounds them.

1. Minimizers found in one document only are dropped: most of the corpus.
2. The paths of the other minimizers are compared whole, by the smallest
   document that holds each.  All windows of a path that a smaller document
   holds repeat it.
3. Where paths of one minimizer differ (they branch), each distinct path, as
   its first document has it, is opened into its edges, and these are compared
   one by one.

Source coordinates (document, first window) of the repeated windows then give
the spans.  Windows are judged on the input, not on what is left.

Every grouping is by a hash and reduces before it shuffles.  Its result is
written, so the joins back are between plain shuffles, which Spark splits where
a key is frequent.  No group is
collected but the minimizers, paths and spans of one document.  Identity rests
on 128 bits: minimizer and path, or two hashes of a window.

Rows with a null id neither repeat nor are repeated.  Null and empty texts have
no words.  Rows that repeat an id never count as smaller than one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectio.llm.common import batches, free_memory, make_room, stage, text_or_empty
from lectio.llm.wordhash import batch_hashes, run_hashes, sliding_min, span_hashes

WINDOW = 13
#: Words of the runs among which minimizers are chosen.
ANCHOR = 4
_INDEX_BITS = 28
_LONG = pa.int64()


def _minimizers(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: text number, first window
    (word of the batch), number of windows, hash of the minimizer."""
    none = np.empty(0, np.int64)
    if len(h) < k:
        return none, none, none, np.empty(0, np.uint64)
    anchors = run_hashes(h, ANCHOR)
    # hash first, then place: the minimum is the leftmost of equal hashes
    low = np.uint64((1 << _INDEX_BITS) - 1)
    ranked = (anchors & ~low) | np.arange(len(anchors), dtype=np.uint64)
    best = (sliding_min(ranked, k - ANCHOR + 1) & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(best)), side="right")
    inside = np.arange(len(best)) + k <= ends[np.minimum(text, len(ends) - 1)]
    keep = np.flatnonzero(inside)
    if not len(keep):
        return none, none, none, np.empty(0, np.uint64)
    best, text = best[keep], text[keep]
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(keep)]]))
    return text[first], keep[first], count, anchors[best[first]]


def _packed_place(mark: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Text mark (32 bits), first window (28) and number of windows (4)."""
    return ((mark << np.uint64(32)) | (first.astype(np.uint64) << np.uint64(4)) | count.astype(np.uint64)).view(np.int64)


def _mark(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text)


def _spans_of(places: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    p = places.view(np.uint64)
    p = p[(p >> np.uint64(32)) == np.uint64(mark)]
    return ((p >> np.uint64(4)) & np.uint64((1 << 28) - 1)).astype(np.int64), (p & np.uint64(15)).astype(np.int64)


def _by_slices(it, limit: int = 1 << 22):
    """Lists of rows (tuples) of about ``limit`` bytes of their column 1.  Of a
    batch, a few rows at a time become Python objects."""
    make_room()
    rows, size = [], 0
    for b in it:
        for start in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(start, 256).columns)):
                rows.append(row)
                size += len(row[1])
                if size >= limit:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows
        rows = []
    free_memory()


def _column(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def repeated_windows(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``places`` (array<bigint>) of every document with repeated
    windows; see :func:`cut` for what a place holds."""
    return _repeated(_compressed(docs, id_col, text_col), docs, k, id_col, text_col)


def _compressed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """Texts as they travel: zstd takes two thirds of what the shuffle's own
    compression leaves.  ``carry`` names further columns, as c0, c1 ..."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"),
                      *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])])
    schema = T.StructType([_column("id"), T.StructField("z", T.BinaryType()), *src.schema.fields[2:]])

    def run(it):
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            data = [z.compress(t.as_py().encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), *b.columns[2:]], schema.names)

    return src.mapInArrow(run, schema)


def _repeated(packed: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    if not ANCHOR < k < ANCHOR + 15:
        raise ValueError(f"windows of {ANCHOR + 1} to {ANCHOR + 14} words")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).filter("id IS NOT NULL")

    def minimizers(it):
        for rows in _by_slices(it):
            h, ends = batch_hashes([t.encode() for _, t in rows])
            text, _, _, m = _minimizers(h, ends, k)
            ids = np.array([r[0] for r in rows], np.int64)[text]
            order = np.lexsort((m, text))  # one row per text and minimizer
            m, text, ids = m[order], text[order], ids[order]
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])])[:len(m)]
            yield pa.RecordBatch.from_arrays([pa.array(m[new].view(np.int64)), pa.array(ids[new])], ["m", "id"])

    found = src.mapInArrow(minimizers, T.StructType([_column("m"), _column("id")]))
    shared = stage(found.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"), "span-minimizers")
    marked = found.join(shared, "m").groupBy("id").agg(F.collect_set("m").alias("ms"))

    def paths(it):
        z = zstandard.ZstdDecompressor()
        for rows in _by_slices(it):
            texts = [z.decompress(r[1]) for r in rows]
            h, ends = batch_hashes(texts)
            text, first, count, m = _minimizers(h, ends, k)
            wanted = np.concatenate([_pairs(i, r[2]) for i, r in enumerate(rows)])
            keep = np.isin(_pair_keys(text, m), wanted)
            text, first, count, m = text[keep], first[keep], count[keep], m[keep]
            begin = np.concatenate([[0], ends[:-1]])
            marks = np.array([_mark(t) for t in texts], np.uint64)
            ids = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)), pa.array(span_hashes(h, first, first + count + k - 1).view(np.int64)),
                 pa.array(ids[text]), pa.array(_packed_place(marks[text], first - begin[text], count))],
                ["m", "path", "id", "place"])

    path_rows = stage(packed.join(marked, "id").mapInArrow(
        paths, T.StructType([_column(c) for c in ("m", "path", "id", "place")])), "span-paths")
    firsts = stage(path_rows.groupBy("m", "path").agg(F.min("id").alias("source")), "span-path-sources")
    placed = path_rows.join(firsts, ["m", "path"])
    whole = placed.filter("source < id").select("id", "place")
    branching = stage(firsts.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"), "span-branching")
    opened = (placed.filter("source = id").join(branching, "m").groupBy("id")
              .agg(F.collect_list("place").alias("places")))

    def edges(it):
        z = zstandard.ZstdDecompressor()
        for rows in _by_slices(it):
            texts = [z.decompress(r[1]) for r in rows]
            h, ends = batch_hashes(texts)
            begin = np.concatenate([[0], ends[:-1]])
            out = []
            for i, (row, t) in enumerate(zip(rows, texts)):
                mark = _mark(t)
                first, count = _spans_of(np.array(row[2], np.int64), mark)
                at = np.repeat(first, count) + _steps(count)
                out.append((at + begin[i], at, np.full(len(at), mark, np.uint64), np.full(len(at), row[0], np.int64)))
            at, own, mark, ids = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_hashes(h, k, 1)[at].view(np.int64)), pa.array(run_hashes(h, k, 2)[at].view(np.int64)),
                 pa.array(ids), pa.array(_packed_place(mark, own, np.ones(len(own), np.int64)))],
                ["a", "b", "id", "place"])

    edge_rows = stage(packed.join(opened, "id").mapInArrow(
        edges, T.StructType([_column(c) for c in ("a", "b", "id", "place")])), "span-edges")
    # an edge of one document only repeats nothing
    edge_firsts = stage(edge_rows.groupBy("a", "b").agg(F.min("id").alias("source"), F.max("id").alias("last"))
                        .filter("source < last").select("a", "b", "source"), "span-edge-sources")
    single = edge_rows.join(edge_firsts, ["a", "b"]).filter("source < id").select("id", "place")
    return whole.unionByName(single).groupBy("id").agg(F.collect_set("place").alias("places"))


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def _pair_keys(text: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Text number and minimizer as one key (a wanted minimizer of another
    text would at worst be compared in vain)."""
    return m * np.uint64(0x9FB21C651E98DF25) + text.astype(np.uint64)


def _pairs(i: int, ms: list[int]) -> np.ndarray:
    m = np.array(ms, np.int64).view(np.uint64)
    return _pair_keys(np.full(len(m), i), m)


def cut(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row without the words that repeat a smaller document:
    ``id_col``, n_words, n_removed, spans (array of start and end, words) and
    kept (text: the words left, joined by one blank)."""
    packed = _compressed(docs, id_col, text_col)
    places = _repeated(packed, docs, k, id_col, text_col).withColumnRenamed("id", "hit")
    span = T.StructType([_column("start"), _column("end")])
    schema = T.StructType([_column(id_col), _column("n_words"), _column("n_removed"),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(it):
        z = zstandard.ZstdDecompressor()

        def rows():
            for b in it:
                for key, data, hits in zip(*(c.to_pylist() for c in b.columns)):
                    words, gone = _judged(z.decompress(data), hits, k)
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(e)} for a, e in turn.reshape(-1, 2)]
                    yield key, len(words), int(gone.sum()), spans, _left(words, gone)

        yield from batches(rows(), arrow, weight=4)

    joined = packed.join(places, F.col("id") == F.col("hit"), "left").select("id", "z", "places")
    return joined.mapInArrow(run, schema)


def _judged(text: bytes, hits: list[int] | None, k: int) -> tuple[list[bytes], np.ndarray]:
    """The words, and which of them repeated windows cover."""
    words = text.split()
    if not hits:
        return words, np.zeros(len(words), bool)
    first, count = _spans_of(np.array(hits, np.int64), _mark(text))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + k - 1, -1)
    return words, np.cumsum(edge)[:-1] > 0


def _left(words: list[bytes], gone: np.ndarray) -> str:
    return b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words).decode()


def without_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns; a text with repeated words is replaced
    by the words left, joined by one blank, any other stays as it is (null as
    an empty text)."""
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = _compressed(docs, id_col, text_col, carry)
    places = _repeated(_compressed(docs, id_col, text_col), docs, k, id_col, text_col).withColumnRenamed("id", "hit")
    joined = packed.join(places, F.col("id") == F.col("hit"), "left").drop("hit")
    schema = T.StructType([_column("id"), T.StructField("text", T.StringType()), *packed.schema.fields[2:]])

    def run(it):
        z = zstandard.ZstdDecompressor()
        for b in it:
            texts = []
            for data, hits in zip(b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                text = z.decompress(data)
                words, gone = _judged(text, hits, k)
                texts.append(_left(words, gone) if gone.any() else text.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[2:-1]], schema.names)

    made = joined.mapInArrow(run, schema).toDF(id_col, text_col, *carry)
    return made.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
