"""Corpus unification.

Heterogeneous labelled sources are projected to one ``(text, label,
source)`` schema and unioned by name; wide level columns are unpivoted;
code maps are small constant maps evaluated in the projection (no join).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import levels as L
from lectio.functions import text as T
from lectio.operators.sequence import with_row_number

UNIFIED = ("text", "label", "source")


def project(df: DataFrame, text_col: str, label, source: str) -> DataFrame:
    """P1 (+ P6 when ``label`` is a constant): rename to the unified schema."""
    lab = label if not isinstance(label, str) else F.col(label)
    return df.select(F.col(text_col).alias("text"), lab.alias("label"), F.lit(source).alias("source"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def clean(df: DataFrame, min_chars: int | None = 5) -> DataFrame:
    """P2 (nulls dropped), P3 (text longer than ``min_chars``), P5 (label
    as int through a tolerant cast; untrusted text never fails the job)."""
    out = df.withColumn("label", F.col("label").cast("string").try_cast("int")).dropna(subset=["text", "label"])
    if min_chars is not None:
        out = out.filter(F.length("text") > min_chars)
    return out


def unpivot_levels(wide: DataFrame, ids: list[str], mapping: dict, name_col: str = "level_name") -> DataFrame:
    """U2 + J7: wide level columns -> ``(ids.., level_name, text, label)``;
    null texts and unmapped level names are dropped."""
    long = wide.unpivot(ids, list(mapping), name_col, "text").dropna(subset=["text"])
    return (long.withColumn("label", L.map_values(name_col, mapping).cast("int"))
            .dropna(subset=["label"]))


def marker_rows(df: DataFrame, order: list[str], markers=L.MARKER_LEVELS, id_name: str = "row_id") -> DataFrame:
    """F8 + P7: level from the first marked column, and a 1-based row id in
    ``order`` (distributed numbering, no single-partition window)."""
    return with_row_number(df.withColumn("level", L.marker_level(markers)), order, id_name)


def grade_labels(df: DataFrame, code_col: str = "Fine-grained") -> DataFrame:
    """``G7`` -> 7; unparsable codes give null labels."""
    return df.withColumn("label", L.parse_grade(code_col))


def band_labels(df: DataFrame, code_col: str = "Grade") -> DataFrame:
    """band code -> mean grade -> level; unmapped codes dropped."""
    return df.withColumn("label", L.grade_band_level(code_col)).dropna(subset=["label"])


def lexicon_sentences(lex: DataFrame, key_col: str = "lemma#pos",
                      level_col: str = "readability (rounded average)",
                      template: str = L.LEXICON_TEMPLATE, mapping: dict = L.LEXICON_LEVELS) -> DataFrame:
    """F13 + F11 + F12: one template sentence per lexicon word, labelled by
    the mapped lexicon level; unmapped levels dropped."""
    word = T.lemma_of(key_col)
    return (lex.select(word.alias("word"), L.map_values(F.col(level_col).cast("int"), mapping).alias("label"))
            .dropna(subset=["label"])
            .select("word", T.template_sentence(template, "word").alias("text"), F.col("label").cast("int")))


def last_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``dict(zip(keys, values))`` semantics — the value of the last row
    in ``order`` wins.  A hash aggregation with map-side combine, so a key
    repeated a billion times costs one partial row per partition."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(value))


#: What a mixture does with a source's rows (``SourceSpec.policy``).
POLICIES = ("train", "own", "stratify")


@dataclass
class SourceSpec:
    """M4: one corpus of a training mixture.

    ``policy`` says how its rows are split: ``train`` only, by the source's
    ``own`` column (``split_col``), or ``stratify``: a share of ``dev_fraction``
    by quota per label, chosen by ``id_col``."""
    name: str
    frame: DataFrame
    text_col: str
    label: object  # column name, Column, or constant level via F.lit
    enabled: bool = True
    policy: str = "train"
    split_col: str = "split"
    id_col: str | None = None
    dev_fraction: float = 0.15


@dataclass
class Mixture:
    """M4: which sources, how they are cleaned, and whether to shuffle."""
    sources: list[SourceSpec] = field(default_factory=list)
    min_chars: int | None = 5
    shuffle_seed: str | None = None

    def build(self) -> DataFrame:
        parts = [project(s.frame, s.text_col, s.label, s.name) for s in self.sources if s.enabled]
        return self._shuffled(clean(union_all(parts), self.min_chars))

    def build_split(self) -> DataFrame:
        """The mixture with a ``split`` column.  A source is cleaned before it
        is stratified, so its quotas count the rows that stay; the sources
        that keep their split, and those for training only, are untouched by
        what is added to them."""
        return self._shuffled(union_all([self._split(s) for s in self.sources if s.enabled]))

    def _split(self, s: SourceSpec) -> DataFrame:
        from lectio.operators.split import stratified_split

        if s.policy not in POLICIES:
            raise ValueError(f"{s.name}: policy {s.policy!r} is none of {POLICIES}")
        extra = {"train": [F.lit("train").alias("split")],
                 "own": [F.col(s.split_col).alias("split")] if s.policy == "own" else None,
                 "stratify": [F.col(s.id_col).alias("_id")] if s.id_col else None}[s.policy]
        if extra is None:
            raise ValueError(f"{s.name}: a stratified source needs an id column")
        label = s.label if not isinstance(s.label, str) else F.col(s.label)
        rows = clean(s.frame.select(F.col(s.text_col).alias("text"), label.alias("label"), F.lit(s.name).alias("source"),
                                    *extra), self.min_chars)
        if s.policy == "stratify":
            rows = stratified_split(rows, "_id", "label", s.dev_fraction)
        return rows.select(*UNIFIED, "split")

    def _shuffled(self, out: DataFrame) -> DataFrame:
        if self.shuffle_seed is None:
            return out
        from lectio.operators.split import shuffle_positions
        rid = F.md5(F.concat_ws("\u0001", "source", "text", "label"))
        return shuffle_positions(out.withColumn("_rid", rid), "_rid", self.shuffle_seed).drop("_rid")


def lemma_lexicon(lex_file: DataFrame, key_col: str = "lemma#pos",
                  score_col: str = "readability (rounded average)") -> DataFrame:
    """S2 + F13 + A11: a ``lemma#pos`` lexicon file as a ``(lemma, score)``
    dictionary keyed by the lemma alone; when a lemma occurs with several
    parts of speech the row that comes last in the file wins.  File order
    is numbered with the distributed row numbering (no single-task window),
    then :func:`last_wins` keeps one row per lemma.  Order is exact for one
    file, as the reference reads it: a multi-line CSV/TSV file is one scan
    split.  Across several part files Spark orders splits by size, so pass
    an explicit order column to :func:`last_wins` there."""
    numbered = with_row_number(lex_file.select(key_col, score_col), None, "_file_row")
    rows = numbered.select(T.lemma_of(key_col).alias("lemma"),
                           F.col(score_col).cast("double").alias("score"), "_file_row")
    return last_wins(rows, "lemma", "score", ["_file_row"])
