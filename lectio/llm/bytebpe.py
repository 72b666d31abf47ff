"""Byte-level BPE encoding and decoding over Arrow batches.

``encode`` turns whole texts into ids by the ``tokenizers`` library (see
:mod:`lectio.llm.bpe`), optionally with the characters that each id touches;
``decode`` reverses the byte table.  Ids travel as little-endian unsigned
32-bit binary, which JVM functions can hash or slice without Python.

Null texts count as empty (no ids).  Rows keep their other columns out of the
way: only the id column is carried, so clashing names cannot arise.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectio.llm.bpe import encoder
from lectio.llm.common import batches, text_or_empty

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """``(id_col, ids binary)`` for every row; with ``offsets`` also
    ``starts`` and ``ends`` (array<bigint>, characters)."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)
    src = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    fields = [src.schema[id_col], T.StructField("ids", T.BinaryType())]
    if offsets:
        fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(it):
        bpe = encoder(path)

        def rows():
            for b in it:
                for key, text in zip(b.column(0), b.column(1)):
                    text = text.as_py()
                    ids = bpe.encode(text)
                    row = (key.as_py(), ids.astype("<u4").tobytes())
                    if offsets:
                        a, z = bpe.char_offsets(text, ids)
                        row += (a.tolist(), z.tolist())
                    yield row

        yield from batches(rows(), arrow, weight=1)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded bytes of every row (``out``, binary; replaces a column
    of that name).  Null ids give null.  ``decoded_text`` makes text of them."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(it):
        bpe = encoder(path)
        for b in it:
            raw = (bpe.decode(np.frombuffer(v.as_buffer(), "<u4")) if v.is_valid else None for v in b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, out])

    return encoded.mapInArrow(run, schema)


def decoded_text(c: str = "decoded"):
    """Text of decoded bytes; byte sequences that are no UTF-8 (ids cut in
    the middle of a character) become U+FFFD."""
    return F.decode(F.col(c), "UTF-8")

