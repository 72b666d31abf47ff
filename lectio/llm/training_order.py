"""Training-order materialisation: shards of fixed-size records in the order
of a keyed permutation.

Every sequence has an index, dense from 0.  A keyed Feistel network permutes
the next power of four; values outside the table are permuted again until they
fall inside (cycle-walking), so the network is a permutation of exactly the
indices, computed for each by itself.  The permuted index is the sequence's
slot in the training order.

Sequences are written in slot order to shards of ``shard_slots`` records.  A
record has a fixed size: the number of tokens, then the ids, padded.  The place
of any slot follows by arithmetic, so a reader starts anywhere and reads on.

The order is written in segments, ranges of whole shards: one segment's
sequences are shuffled at a time, partitioned by shard (a range of slots), each
shard written by one task that replaces the file when it is complete.  A segment with a manifest is
done; a run that is started again goes on with the next.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.bpe import encoded, encoder
from lectio.llm.common import batches, stage, text_or_empty
from lectio.llm.packing import CAPACITY, LINEAR, POOL_SEQUENCES, QUADRATIC, packed
from lectio.llm.wordhash import mix
from lectio.session import path_exists

ROUNDS = 6
#: Records of a shard (128 MB at 1024 ids of two bytes), and segments.
SHARD_SLOTS, SEGMENTS = 1 << 16, 4


# -- the permutation ----------------------------------------------------------
def _network(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    forward = rounds.step > 0
    for r in rounds:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93 + 1) % (1 << 64))
        if forward:
            left, right = right, left ^ (mix(right ^ salt) & low)
        else:
            left, right = right ^ (mix(left ^ salt) & low), left
    return (left << np.uint64(half)) | right


def _walk(x: np.ndarray, n: int, key: int, rounds: range) -> np.ndarray:
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    x = _network(np.asarray(x).astype(np.uint64), half, key, rounds)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _network(x[out], half, key, rounds)
    return x.astype(np.int64)


def slot_of(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indices below ``n``."""
    return _walk(index, n, key, range(ROUNDS))


def index_of(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The index at each slot: the network backwards."""
    return _walk(slot, n, key, range(ROUNDS - 1, -1, -1))


# -- sequences ------------------------------------------------------------------
def sequences(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
              text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packed sequences of documents: part, place (their number within the
    part), ids (binary, in the vocabulary's integer type).  Null text:
    empty."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("place", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def run(it):
        bpe = encoder(path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], bpe.dtype)
        documents = ((None, np.concatenate([ids, end])) for _, _, ids in encoded(bpe, it))

        def rows():
            found = packed(documents, 0, capacity, POOL_SEQUENCES, LINEAR, QUADRATIC)
            for place, pieces in groupby(found, key=lambda r: r[5]):
                yield part, place, b"".join(r[3].tobytes() for r in pieces)

        yield from batches(rows(), arrow, weight=2)

    return src.mapInArrow(run, schema)


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Written rows of part and place with a dense ``index`` from 0, and how
    many there are."""
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return rows.join(F.broadcast(offsets), "part").withColumn("index", F.col("offset") + F.col("place")), total


# -- shards -----------------------------------------------------------------------
def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:)?/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path)


def shard_path(out: str, shard: int) -> str:
    return f"{out}/shard-{shard:08d}.bin"


def record_bytes(capacity: int, item: int) -> int:
    return 4 + capacity * item


def materialise(docs: DataFrame, out: str, key: int = 1, capacity: int = CAPACITY, shard_slots: int = SHARD_SLOTS,
                segments: int = SEGMENTS, path: str | None = None, end_id: int = 0, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """Write the training order of packed documents below ``out`` (a store
    that every executor reaches); returns the manifest, one row per shard:
    shard, first_slot, n_slots, bytes, crc32.  An empty table has no shard.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows, total = indexed(stage(sequences(docs, path, end_id, capacity, text_col, id_col), "order-sequences"))
    item = encoder(path).dtype.itemsize
    size = record_bytes(capacity, item)

    @F.pandas_udf("long")
    def slots(index: pd.Series) -> pd.Series:
        return pd.Series(slot_of(index.to_numpy(), total, key))

    n_shards = -(-total // shard_slots)
    per_segment = max(1, -(-n_shards // segments))
    fields = ("shard", "first_slot", "n_slots", "bytes", "crc32")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in fields])
    arrow = pa.schema([(c, pa.int64()) for c in fields])

    def write(it):
        store, root = _store(out)
        store.create_dir(root, recursive=True)

        def records():
            for b in it:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for shard, own in groupby(records(), key=lambda r: r[0]):
            final, part = shard_path(root, shard), f"{root}/_part-{uuid.uuid4().hex}"
            n = crc = 0
            with store.open_output_stream(part) as f:
                for _, slot, ids in own:
                    if slot != shard * shard_slots + n:
                        raise ValueError(f"shard {shard} misses slot {shard * shard_slots + n}")
                    record = (struct.pack("<I", len(ids) // item) + ids).ljust(size, b"\0")
                    f.write(record)
                    crc, n = zlib.crc32(record, crc), n + 1
            store.move(part, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (shard, shard * shard_slots, n, n * size, crc)], schema=arrow)

    done = []
    for segment in range(-(-n_shards // per_segment)):
        manifest = f"{out}/manifest/segment-{segment:05d}"
        if not path_exists(spark, f"{manifest}/_SUCCESS"):
            first, last = segment * per_segment, min((segment + 1) * per_segment, n_shards)
            placed = rows.select(slots("index").alias("slot"), "ids").select(
                F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "ids")
            own = placed.filter((F.col("shard") >= first) & (F.col("shard") < last))
            # a shard is a range of slots and a task of its own
            place = (F.col("shard") - F.lit(first)).cast("int")
            dealt = own.repartitionById(last - first, place).sortWithinPartitions("shard", "slot")
            dealt.mapInArrow(write, schema).write.mode("overwrite").parquet(manifest)
            spark.sparkContext._jvm.System.gc()  # the segment's shuffle files may go
        done.append(manifest)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def read_range(out: str, start: int, count: int, capacity: int = CAPACITY, shard_slots: int = SHARD_SLOTS,
               item: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from any slot on; reading goes on across shards and stops
    where the order ends."""
    store, root = _store(out)
    size, slot, end = record_bytes(capacity, item), start, start + count
    while slot < end:
        shard = slot // shard_slots
        if store.get_file_info(shard_path(root, shard)).type != fs.FileType.File:
            return
        with store.open_input_file(shard_path(root, shard)) as f:
            f.seek((slot - shard * shard_slots) * size)
            while slot < min(end, (shard + 1) * shard_slots):
                record = f.read(size)
                if len(record) < size:
                    return
                n = struct.unpack_from("<I", record)[0]
                yield slot, np.frombuffer(record, f"<u{item}", n, 4)
                slot += 1


def records(manifest: DataFrame, out: str, capacity: int = CAPACITY, shard_slots: int = SHARD_SLOTS,
            item: int = 2) -> DataFrame:
    """The written records, read shard by shard in parallel: slot, shard,
    byte_offset, length, ids (binary, little-endian unsigned 32-bit)."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("slot", "shard", "byte_offset", "length")],
                           T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([(c, pa.int64()) for c in ("slot", "shard", "byte_offset", "length")] + [("ids", pa.binary())])
    size = record_bytes(capacity, item)

    def run(it):
        def rows():
            for b in it:
                for first, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for slot, ids in read_range(out, first, n, capacity, shard_slots, item):
                        yield slot, slot // shard_slots, (slot % shard_slots) * size, len(ids), ids.astype("<u4").tobytes()

        yield from batches(rows(), arrow, weight=4)

    return manifest.select("first_slot", "n_slots").mapInArrow(run, schema)
