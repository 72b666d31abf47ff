"""The corpus pipeline: quality, exact copies, near copies, repeated spans,
packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and returns a DataFrame; ``run`` writes each as Parquet below the shared
checkpoint folder and reads it again as the next stage's documents.  All but
the last return the columns of ``documents``.

Null texts count as empty; documents without words are of no quality and go in
the first stage.  Rows with a null id are nobody's copy and stay.  Rows that
repeat an id and a text are one document, and stay or go together.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm import exact, ngram_join, packing, quality, substring
from lectio.llm.common import fold_ascii, read_table, stage, text_or_empty
from lectio.operators.sequence import with_row_number


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of equal texts (A-Z folded)."""
    gone = (exact.exact_dedup(docs).filter("NOT kept AND doc_id IS NOT NULL")
            .select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_sha")))
    sha = F.unhex(F.sha2(fold_ascii(text_or_empty()), 256))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (five words, 0.75).  Where
    an id has different texts, each is a document of its own."""
    sha = F.unhex(F.sha2(text_or_empty(), 256))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", sha.alias("_sha"))
    if texts.groupBy("doc_id").agg(F.min("_sha").alias("a"), F.max("_sha").alias("b")).filter("a <> b").isEmpty():
        gone = (ngram_join.jaccard_components(docs).filter("component_id < doc_id")
                .select(F.col("doc_id").alias("gone_id")))
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    numbers = with_row_number(texts.distinct(), ["doc_id", "_sha"], "_no")
    rows = stage(docs.withColumn("_sha", sha).join(numbers, ["doc_id", "_sha"], "left")
                 .select(*docs.columns, "_no"), "pipeline-numbered")
    found = ngram_join.jaccard_components(rows, id_col="_no").filter("component_id < _no").distinct()
    first = numbers.select(F.col("_no").alias("component_id"), F.col("doc_id").alias("first_id"))
    gone = (found.join(numbers, "_no").join(first, "component_id").filter("first_id < doc_id")
            .select(F.col("_no").alias("gone_no")))
    return rows.join(gone, rows["_no"] == gone["gone_no"], "left_anti").select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that a document with a
    smaller id has too; ``n_chars`` follows the text."""
    cut = substring.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar),
          ("substring dedup", unrepeated), ("packing", sequences)]

#: Expectation-maximisation, packing and token ids are beyond SQL; the tests
#: hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
