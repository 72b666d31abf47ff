"""Token counts that follow edits.

Every document keeps a segment tree over runs of pre-tokens: a leaf is a run
that begins and ends where pre-tokens must end, and every inner node holds the
characters and tokens below it.  An edit is found by descending along the
character sums; only the leaves that it touches are encoded again, together
with neighbours whose boundary the new text no longer guarantees, and only the
sums on their paths to the root change.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectio.llm.bpe import BOUNDARY, ByteBpe, encoder
from lectio.llm.common import batches, text_or_empty

DEFAULT_VOCAB = "byte_bpe_50k.json"
#: Characters of a leaf, about; one that grows to four times as many is split.
LEAF_CHARS = 256
EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("deleted", T.LongType()),
                     T.StructField("inserted", T.StringType())])
TREE = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())),
        T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))]


def runs(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Leaves of a text: runs of at least ``leaf_chars`` characters."""
    out, at = [], 0
    while len(text) - at > leaf_chars:
        m = BOUNDARY.search(text, at + leaf_chars)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class SegmentTree:
    """Sums of characters and tokens over a document's leaves."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.leaves, self.tokens = leaves, tokens
        self.half = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [[0] * (2 * self.half) for _ in range(2)]
        for s, values in zip(self.sums, ([len(x) for x in leaves], tokens)):
            s[self.half:self.half + len(values)] = values
            for i in range(self.half - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]

    n_chars = property(lambda self: self.sums[0][1])
    n_tokens = property(lambda self: self.sums[1][1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character, and the place within it."""
        chars, i = self.sums[0], 1
        while i < self.half:
            i *= 2
            if char >= chars[i]:
                char -= chars[i]
                i += 1
        return i - self.half, char

    def put(self, leaf: int, text: str, tokens: int) -> None:
        """Replace a leaf and update the sums above it."""
        old = len(self.leaves[leaf]), self.tokens[leaf]
        self.leaves[leaf], self.tokens[leaf] = text, tokens
        for s, by in zip(self.sums, (len(text) - old[0], tokens - old[1])):
            i = leaf + self.half
            while i and by:
                s[i] += by
                i //= 2

    def edit(self, bpe: ByteBpe, start: int, deleted: int, inserted: str, leaf_chars: int = LEAF_CHARS) -> int:
        """Replace ``deleted`` characters from ``start`` by ``inserted``;
        returns the characters encoded again.  Both are cut to the text."""
        start = min(max(start, 0), self.n_chars)
        deleted = min(max(deleted, 0), self.n_chars - start)
        if not self.leaves:
            self.__init__([""], [0])
        if start == self.n_chars:  # the end belongs to the last leaf
            first = max((i for i, x in enumerate(self.leaves) if x), default=0)
            at = len(self.leaves[first])
        else:
            first, at = self.find(start)
        last, upto = self.find(start + deleted - 1) if deleted else (first, at - 1)
        text = self.leaves[first][:at] + inserted + self.leaves[last][upto + 1:]
        # Context: the boundary to the left needs a blank or line feed after
        # it, the one to the right something else than white space before it.
        while text and text[0] not in " \n" and (i := self._next(first, -1)) is not None:
            text, first = self.leaves[i] + text, i
        while text and text[-1].isspace() and (i := self._next(last, 1)) is not None:
            text, last = text + self.leaves[i], i
        tokens = len(bpe.encode(text))
        self.put(first, text, tokens)
        for i in range(first + 1, last + 1):
            self.put(i, "", 0)
        if len(text) > 4 * leaf_chars:  # split the grown leaf; the others keep their counts
            parts = runs(text, leaf_chars)
            if len(parts) > 1:
                counts = [len(bpe.encode(p)) for p in parts]
                leaves = [x for i, x in enumerate(self.leaves) if x and i < first] + parts
                numbers = [n for i, n in enumerate(self.tokens) if self.leaves[i] and i < first] + counts
                leaves += [x for i, x in enumerate(self.leaves) if x and i > first]
                numbers += [n for i, n in enumerate(self.tokens) if self.leaves[i] and i > first]
                self.__init__(leaves, numbers)
        return len(text)

    def _next(self, leaf: int, step: int) -> int | None:
        i = leaf + step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None


def build_trees(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS,
                text_col: str = "text") -> DataFrame:
    """Every row with the leaves of its tree: ``leaf_chars`` and
    ``leaf_tokens`` (the inner sums follow from them), which replace columns
    of these names.  Null text: no leaf."""
    path = path or public_tokenizers.path(DEFAULT_VOCAB)
    docs = docs.drop("leaf_chars", "leaf_tokens")
    at = docs.columns.index(text_col)

    def run(it):
        bpe = encoder(path)
        for b in it:
            chars, tokens = [], []
            for text in b.column(at):
                leaves = runs(text.as_py() or "", leaf_chars)
                chars.append([len(x) for x in leaves])
                tokens.append([len(bpe.encode(x)) for x in leaves])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                [*b.schema.names, "leaf_chars", "leaf_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *TREE]))


def apply_edits(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id",
                text_col: str = "text", edits_col: str = "edits", with_text: bool = False) -> DataFrame:
    """Counts after edits, for rows of :func:`build_trees` that also hold
    ``edits`` (array of start, deleted, inserted), applied in order.

    Returns the id, tokens and characters before and after, the number of
    edits, ``chars_encoded`` (what was encoded again), the new tree and, if
    asked for, the new text.  Null edits, or null fields within one, change
    nothing; positions beyond the text are cut to it.
    """
    path = path or public_tokenizers.path(DEFAULT_VOCAB)
    src = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"), "leaf_chars", "leaf_tokens",
                      F.col(edits_col).alias("edits"))
    numbers = ("tokens_before", "tokens_after", "chars_before", "chars_after", "n_edits", "chars_encoded")
    schema = T.StructType([src.schema[id_col], *[T.StructField(c, T.LongType()) for c in numbers], *TREE,
                           *[T.StructField("text", T.StringType())] * with_text])
    arrow = to_arrow_schema(schema)

    def run(it):
        bpe = encoder(path)

        def rows():
            for b in it:
                for row in b.to_pylist():
                    leaves, at = [], 0
                    for n in row["leaf_chars"]:
                        leaves.append(row["text"][at:at + n])
                        at += n
                    tree = SegmentTree(leaves, list(row["leaf_tokens"]))
                    before, encoded, done = (tree.n_tokens, tree.n_chars), 0, 0
                    for e in row["edits"] or ():
                        if e is None or None in e.values():
                            continue
                        encoded += tree.edit(bpe, e["start"], e["deleted"], e["inserted"], leaf_chars)
                        done += 1
                    out = (row[id_col], before[0], tree.n_tokens, before[1], tree.n_chars, done, encoded,
                           [len(x) for x in tree.leaves if x], [n for x, n in zip(tree.leaves, tree.tokens) if x])
                    yield out + ("".join(tree.leaves),) * with_text

        yield from batches(rows(), arrow, weight=7)

    return src.mapInArrow(run, schema)


def demo_edits(text: str = "text", tag: str = "source"):
    """Three edits that a revision makes, derived from the row: a stretch in
    the middle becomes a capitalised stretch of the beginning, a note with
    the row's tag goes in at a quarter, and 16 characters go at the end."""
    t, n = text_or_empty(text), F.char_length(text_or_empty(text)).cast("long")
    note = F.concat(F.lit("\n["), F.coalesce(F.col(tag).cast("string"), F.lit("")), F.lit("] "))
    edits = [(F.floor(n / 2), 32, F.upper(F.substring(t, 1, 24))),
             (F.floor(n / 4), 0, note),
             (F.greatest(n - 24, F.lit(0)), 16, F.lit(""))]
    return F.array(*[F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"),
                              inserted.alias("inserted")) for start, deleted, inserted in edits])
