"""The document-scoring plan run incrementally with Structured Streaming.

The reference has no streaming.  This module only lets the *same* batch
plan consume documents as they land (new Parquet files in a folder):
segmentation, token lookup and sentence scoring are stateless per row, and
a document arrives whole in one file, so its MAX roll-up is exact within a
micro-batch — no state store and no watermark are needed.  Output is
written per micro-batch by ``foreachBatch`` into a folder named by the
batch id (a replayed batch overwrites its own folder), and progress lives
in the checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectio.operators import features as feat
from lectio.operators import rollup
from lectio.operators.segment import sentences

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def score_batch(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Documents -> (doc_id, level): the batch flagship plan.  ``lexicon``:
    ``(lemma, score)``, made into a dictionary first, or a stored dictionary."""
    sent = sentences(docs.select("doc_id", "text"), "clean")
    scored = rollup.linear_score(feat.lexical_sums(sent, words_of(lexicon), fold_case=True))
    return rollup.fill_levels(docs, rollup.doc_level_from_raw(scored))


def words_of(lexicon: DataFrame) -> DataFrame:
    """The lexicon as a dictionary keyed by lower-cased words."""
    return lexicon if "word" in lexicon.columns else feat.dictionary(lexicon, fold_case=True)


def start_scoring(spark: SparkSession, source_dir: str, lexicon: DataFrame, out_dir: str,
                  checkpoint_dir: str, available_now: bool = True, max_files_per_trigger: int = 64):
    """Start the streaming query; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    words = words_of(lexicon)  # once, not in every micro-batch

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id, overwritten on replay: idempotent output
        score_batch(batch, words).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
