"""End-to-end command-line flows on files in the reference's input schemas."""

import json

from pyspark.sql import functions as F

from lectio.cli import main
from lectio.operators.segment import sentences
from lectio.plans import fixtures as fx
from lectio.session import scratch_path
from lectio.sources import sinks as K
from tests.conftest import SF_SMALL


def test_cli_flows(spark, capsys):
    docs = fx.documents(spark, SF_SMALL)
    gold = fx.gold_label()
    main_csv = K.write_csv(
        sentences(docs.select("doc_id", "text", gold.alias("label")), "untrimmed", keep=("label",))
        .select(F.col("sentence").alias("Sentence"), F.col("label").alias("Readability_Level_19")),
        scratch_path(spark, "main"))
    graded = K.write_tsv(fx.graded_wide(fx.table(spark, SF_SMALL, "conversations")).drop("conv_id"),
                         scratch_path(spark, "graded"))
    grades = K.write_csv(fx.grade_codes(fx.table(spark, SF_SMALL, "benchmark")).drop("item_id"),
                         scratch_path(spark, "grades"))
    lexicon = K.write_tsv(fx.lexicon_tsv_form(fx.derived_lexicon(docs)), scratch_path(spark, "lexicon"))
    doc_csv = K.write_csv(docs.select(F.col("doc_id").alias("ID"), F.col("text").alias("Sentences")),
                          scratch_path(spark, "docs"))
    sent_csv = K.write_csv(sentences(docs.select("doc_id", "text"), "clean")
                           .select(F.concat_ws("-", "doc_id", "pos").alias("ID"), F.col("sentence").alias("Sentence")),
                           scratch_path(spark, "sents"))
    gold_csv = K.write_csv(docs.select(F.col("doc_id").alias("ID"), gold.alias("Readability_Level_19")),
                           scratch_path(spark, "gold"))

    corpus, model = scratch_path(spark, "corpus"), scratch_path(spark, "model")
    assert main(["prepare", "--main", main_csv, "--graded", graded, "--grades", grades,
                 "--lexicon", lexicon, "--out", corpus]) == 0
    prepared = spark.read.option("header", True).option("multiLine", True).csv(corpus)
    assert {r.source for r in prepared.select("source").distinct().collect()} == {"main", "graded", "grade", "lexicon"}
    assert main(["train", "--corpus", corpus, "--model", model, "--features", "4096", "--iterations", "5"]) == 0
    assert "dev_qwk" in json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    sub_s, sub_d = scratch_path(spark, "sub-s"), scratch_path(spark, "sub-d")
    assert main(["predict-sentences", "--model", model, "--input", sent_csv, "--out", sub_s]) == 0
    assert main(["predict-documents", "--model", model, "--input", doc_csv, "--out", sub_d]) == 0
    ds = spark.read.option("header", True).csv(sub_d)
    assert ds.columns == ["Document ID", "Prediction"] and ds.count() == docs.count()
    assert spark.read.option("header", True).csv(sub_s).count() == sentences(docs, "clean").count()
    assert main(["evaluate", "--pred", sub_d, "--gold", gold_csv]) == 0
    scores = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(scores) == {"acc", "acc_pm1", "avg_abs_dist", "acc_7", "acc_5", "acc_3", "qwk", "unmatched_predictions", "unmatched_gold"}
