"""Command-line flows over files in the reference's input schemas.

    python -m lectio prepare   --main train.csv [--graded corpus.tsv] [--grades grades.csv]
                               [--lexicon lexicon.tsv] [--graded-map A|B] --out corpus_dir
    python -m lectio train     --corpus corpus_dir --model model_dir [--test-fraction 0.1]
    python -m lectio predict-sentences --model model_dir --input test.csv --out submission_dir
    python -m lectio predict-documents --model model_dir --input docs.csv --out submission_dir
    python -m lectio evaluate  --pred submission_dir --gold gold.csv [--labels observed|fixed]

Inputs (CSV unless noted): main corpus ``Sentence, Readability_Level_19``;
graded corpus TSV ``L3, L4, L5``; school-grade corpus ``Text,
Fine-grained``; lexicon TSV ``lemma#pos, readability (rounded average)``;
sentence test ``ID, Sentence``; document test ``ID, Sentences`` (newline-
joined); gold ``ID, Readability_Level_19``.  Every step is a Spark job;
outputs are directories of part files.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions import levels as L
from lectio.operators import corpus as C
from lectio.operators import metrics as M
from lectio.operators import models as MD
from lectio.operators import rollup
from lectio.operators import split as SP
from lectio.operators.joins import unmatched_count
from lectio.operators.segment import sentences
from lectio.sources import readers as R
from lectio.sources import sinks as K

S = T.StringType()


def _schema(*names, types=None) -> T.StructType:
    types = types or {}
    return T.StructType([T.StructField(n, types.get(n, S)) for n in names])


def _read(spark: SparkSession, path: str, names: tuple, sep: str = ",") -> DataFrame:
    """Read the named columns (in any file order) as strings, after checking
    the header; pandas-style missing markers become null (S1, S4, S8)."""
    found = R.clean_header(R.header_of(spark, path, sep))
    R.check_columns(found, list(names), path)
    df = R.read_csv(spark, path, _schema(*found), sep=sep, na_tokens=R.NA_TOKENS)
    return df.select(*names)


def prepare(spark: SparkSession, args) -> DataFrame:
    """§3.1: unify the corpora into ``(text, label, source)``, clean, shuffle."""
    srcs = [C.SourceSpec("main", _read(spark, args.main, ("Sentence", "Readability_Level_19")),
                         "Sentence", "Readability_Level_19")]
    if args.graded:
        mapping = L.GRADED_LEVELS_A if args.graded_map == "A" else L.GRADED_LEVELS_B
        wide = _read(spark, args.graded, ("L3", "L4", "L5"), sep="\t").withColumn("_row", F.lit(0))
        srcs.append(C.SourceSpec("graded", C.unpivot_levels(wide, ["_row"], mapping), "text", "label"))
    if args.grades:
        g = C.grade_labels(_read(spark, args.grades, ("Text", "Fine-grained")))
        srcs.append(C.SourceSpec("grade", g, "Text", "label"))
    if args.lexicon:
        lex = _read(spark, args.lexicon, ("lemma#pos", "readability (rounded average)"), sep="\t")
        srcs.append(C.SourceSpec("lexicon", C.lexicon_sentences(lex), "text", "label"))
    return C.Mixture(srcs, min_chars=5, shuffle_seed=args.seed).build()


def train(spark: SparkSession, args):
    """§3.2: stratified dev split, fit the text regressor, report dev QWK."""
    corpus = spark.read.options(**R.CSV_READ_OPTIONS).schema(
        "text string, label int, source string, shuffle_pos long").csv(args.corpus)
    corpus = corpus.withColumn("_id", F.col("shuffle_pos"))
    parts = SP.stratified_split(corpus, "_id", "label", args.test_fraction)
    tr, dev = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "dev")
    model = MD.fit_regressor(tr, "text", "label", num_features=args.features, max_iter=args.iterations)
    model.write().overwrite().save(args.model)
    scored = MD.regression_levels(model, dev, ["label"])
    return M.qwk(scored.select(F.col("label").alias("gold"), F.col("level").alias("pred"))).first()


def predict_sentences(spark: SparkSession, args) -> DataFrame:
    from pyspark.ml import PipelineModel
    test = _read(spark, args.input, ("ID", "Sentence")).select(
        F.col("ID").alias("id"), F.col("Sentence").alias("text"))
    test = test.withColumn("text", F.coalesce("text", F.lit("")))
    out = MD.regression_levels(PipelineModel.load(args.model), test, ["id"])
    return K.submission_frame(out, "id", "level", ("Sentence ID", "Prediction"))


def predict_documents(spark: SparkSession, args) -> DataFrame:
    """M11 on plain text: F2 -> model -> A1 (MAX of raw) -> F17 -> J1 (fill 1)."""
    from pyspark.ml import PipelineModel
    docs = _read(spark, args.input, ("ID", "Sentences")).select(
        F.col("ID").alias("doc_id"), F.col("Sentences").alias("text"))
    sent = sentences(docs, "clean").withColumnRenamed("sentence", "text")
    scored = MD.regression_levels(PipelineModel.load(args.model), sent, ["doc_id"])
    filled = rollup.fill_levels(docs, rollup.doc_level_from_raw(scored))
    return K.submission_frame(filled, "doc_id", "level", ("Document ID", "Prediction"))


def evaluate(spark: SparkSession, args):
    """A10 score set of a submission against gold levels (J4 by id), and how
    many ids of either side have no partner."""
    pred = spark.read.options(**R.CSV_READ_OPTIONS).csv(args.pred)
    id_col, p_col = pred.columns[0], pred.columns[1]
    gold = _read(spark, args.gold, ("ID", "Readability_Level_19"))
    pred = pred.select(F.col(id_col).alias("ID"), F.col(p_col).try_cast("int").alias("pred"))
    gold = gold.select("ID", F.col("Readability_Level_19").try_cast("int").alias("gold"))
    unmatched = {"unmatched_predictions": unmatched_count(pred, gold, "ID"),
                 "unmatched_gold": unmatched_count(gold, pred, "ID")}
    pairs = pred.join(gold, "ID", "inner")
    return M.score_set(pairs, M.equal_width_bands(spark), labels=args.labels).first().asDict() | unmatched


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m lectio")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--main", required=True)
    p.add_argument("--graded")
    p.add_argument("--graded-map", choices=["A", "B"], default="A")
    p.add_argument("--grades")
    p.add_argument("--lexicon")
    p.add_argument("--seed", default="42")
    p.add_argument("--out", required=True)
    p = sub.add_parser("train")
    p.add_argument("--corpus", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--test-fraction", type=float, default=0.1)
    p.add_argument("--features", type=int, default=1 << 18)
    p.add_argument("--iterations", type=int, default=50)
    for name in ("predict-sentences", "predict-documents"):
        p = sub.add_parser(name)
        p.add_argument("--model", required=True)
        p.add_argument("--input", required=True)
        p.add_argument("--out", required=True)
    p = sub.add_parser("evaluate")
    p.add_argument("--pred", required=True)
    p.add_argument("--gold", required=True)
    p.add_argument("--labels", choices=["observed", "fixed"], default="observed")
    p.add_argument("--bands", choices=["equal-width"], default="equal-width",
                   help="7/5/3 coarse bands; the reference defines none, so equal-width cuts of "
                        "1..19 are this tool's explicit choice")
    args = ap.parse_args(argv)

    from lectio.session import build_session
    spark = build_session(app_name=f"lectio-{args.cmd}")
    if args.cmd == "prepare":
        K.write_csv(prepare(spark, args), args.out)
    elif args.cmd == "train":
        print(json.dumps({"dev_qwk": train(spark, args)["qwk"]}))
    elif args.cmd == "predict-sentences":
        K.write_csv(predict_sentences(spark, args), args.out)
    elif args.cmd == "predict-documents":
        K.write_csv(predict_documents(spark, args), args.out)
    elif args.cmd == "evaluate":
        print(json.dumps(evaluate(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
