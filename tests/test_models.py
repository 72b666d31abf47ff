from pyspark.sql import functions as F

from lectio.functions.levels import score_to_level
from lectio.operators import metrics as M
from lectio.operators import models as MD
from lectio.operators.segment import sentences
from tests.conftest import SF_SMALL


def test_regressor_learns_a_learnable_gold(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sent = sentences(docs.select("doc_id", "text"), "clean")
    # learnable gold: level grows with the share of long words
    lab = sent.withColumn("label", (F.least(F.lit(19), F.lit(1) + F.size(F.split("sentence", " ")) / 2)).cast("int"))
    model = MD.fit_regressor(lab, "sentence", "label", num_features=1 << 12, max_iter=30)
    out = model.transform(lab.withColumn("_target", F.col("label") - 1))
    r = M.qwk(out.select(F.col("label").alias("gold"), score_to_level("_raw").alias("pred"))).first()
    assert r.qwk > 0.3
    ev = M.QWKEvaluator(labelCol="label", predictionCol="_raw")
    assert ev.evaluate(out.withColumn("_raw", F.col("_raw") + 1)) > 0.3


def test_hybrid_heads(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(300)
    data = emb.withColumn("f1", F.element_at("embedding", 1).cast("double")).withColumn("f2", F.lit(1.0))
    lin = MD.fit_hybrid(data, "embedding", ["f1", "f2"], "label", head="linear")
    out = MD.hybrid_predict(lin, data, "embedding", ["vec_id", "label"])
    assert out.count() == 300
    mlp = MD.fit_hybrid(data, "embedding", ["f1", "f2"], "label", head="mlp", n_classes=10, hidden=(8,))
    pred = MD.hybrid_predict(mlp, data, "embedding", ["vec_id", "label"])
    assert {r.prediction for r in pred.collect()} <= set(float(i) for i in range(10))
