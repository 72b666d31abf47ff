"""Counts from the writing job, splits with many classes and ties, the split
policies of a mixture, and lookups beyond the broadcast bound."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectio.operators import corpus as C
from lectio.operators import metrics as M
from lectio.operators import split as SP
from lectio.session import scratch_path
from lectio.sources import readers as R
from lectio.sources import sinks as K


# -- counts ---------------------------------------------------------------------
def test_counts_come_from_the_writing_job(spark):
    seen = M.StageCounts()
    rows = seen.count(spark.range(1000).repartition(7), {"rows": F.lit(1), "even": (F.col("id") % 2 == 0)})
    kept = seen.count(rows.filter("id < 10"), {"kept": F.lit(1)})
    K.write_parquet(kept, scratch_path(spark, "counted"))
    assert seen.values() == {"rows": 1000, "even": 500, "kept": 10}
    assert {tuple(r) for r in seen.table(spark).collect()} == {("rows", 1000), ("even", 500), ("kept", 10)}


def test_counts_of_an_empty_stage(spark):
    seen = M.StageCounts()
    K.write_parquet(seen.count(spark.range(0), {"rows": F.lit(1)}), scratch_path(spark, "counted"))
    assert seen.values() == {"rows": 0}


def test_rejected_rows_are_counted_by_the_scan_that_keeps_the_rest(spark, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("id,name,n\n1,a,1\n2,b,x\n3,c,3\n4,d,y\n")
    schema = ST.StructType([ST.StructField("id", ST.LongType()), ST.StructField("name", ST.StringType()),
                            ST.StructField("n", ST.LongType())])
    good, rejected = R.read_warning(spark, str(tmp_path / "a.csv"), schema)
    with caplog.at_level("WARNING", logger="lectio.readers"):
        # the malformed column is not used: its rows are rejected all the same
        assert sorted(r.id for r in good.select("id").collect()) == [1, 3]
        assert rejected.warn() == 2
    assert "2 malformed rows" in caplog.text


# -- stratified split ------------------------------------------------------------
def dev_counts(df):
    out = defaultdict(Counter)
    for r in df.collect():
        out[r.label][r.split] += 1
    return out


@pytest.mark.parametrize("candidates", [SP.CANDIDATES, 10])
def test_a_third_of_the_rows_under_one_id(spark, candidates):
    rows = [(1, "a", i) for i in range(700)] + [(i + 10, "a", i) for i in range(700)] + [(i % 50, "b", i) for i in range(600)]
    rows += [(None, "c", i) for i in range(99)] + [(5, None, 0)]
    df = spark.createDataFrame(rows, "id long, label string, n int").repartition(6)
    out = SP.stratified_split(df, "id", "label", 0.15, candidates=candidates)
    assert out.columns == ["id", "label", "n", "split"] and out.count() == len(rows)
    want, _ = SP.quotas([("a", 1400), ("b", 600), ("c", 99)], 0.15)
    got = dev_counts(out)
    assert {k: got[k]["dev"] for k in "abc"} == want
    assert got[None] == Counter({None: 1})
    key = {r.id: r.k for r in df.select("id", SP.split_key("id").alias("k")).distinct().collect()}
    for label in "abc":  # every dev row ranks before every train row
        dev, train = ([key[r.id] or "" for r in out.filter(f"label = '{label}' AND split = '{s}'").collect()] for s in ("dev", "train"))
        assert not dev or not train or max(dev) <= min(train)


def test_as_many_classes_as_rows_allow(spark):
    n = 100_000
    df = spark.range(2 * n).selectExpr("id", f"CAST(id % {n} AS STRING) AS label")
    df = df.union(spark.range(50_000).selectExpr(f"id + {3 * n}", "'big' AS label"))
    out = SP.stratified_split(df, "id", "label", 0.2).cache()
    total = 2 * n + 50_000
    assert out.filter("split = 'dev'").count() == math.ceil(0.2 * total)
    per = out.groupBy("label").agg(F.sum((F.col("split") == "dev").cast("long")).alias("d"), F.count(F.lit(1)).alias("n"))
    off = per.filter(F.abs(F.col("d") - F.lit(0.2) * F.col("n")) > 1)
    assert off.isEmpty()  # largest remainder: no class is off by more than one row
    out.unpersist()


def test_tied_rows_are_numbered_over_many_tasks(spark):
    df = spark.range(20_000).selectExpr("'x' AS _lab", "id AS v").repartition(8)
    placed = SP._places(df, "_lab")
    assert sorted(r._place for r in placed.select("_place").collect()) == list(range(1, 20_001))
    # the rows of a label are never ranked in a window of their own
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(_lab" not in plan


def test_quota_table_equals_the_list(spark):
    counts = [("a", 13), ("b", 1), ("c", 29), ("d", 7), ("e", 7), ("f", 2)]
    for share in (0.0, 0.1, 0.15, 0.5, 1.0):
        want, _ = SP.quotas(counts, share)
        got = {r.label: r.need for r in SP.quota_table(spark.createDataFrame(counts, "label string, n long"), share).collect()}
        assert got == want
    assert SP.quota_table(spark.createDataFrame([], "label string, n long"), 0.15).count() == 0


# -- mixtures --------------------------------------------------------------------
def test_split_policies(spark):
    own = spark.createDataFrame([("text of main 1", 3, "dev"), ("text of main 2", 4, "train"), ("tiny", 4, "dev")],
                                "t string, l int, split string")
    added = spark.createDataFrame([(i, f"an added text {i}", i % 2) for i in range(40)] + [(99, None, 1)], "k long, t string, l int")
    only = spark.createDataFrame([("a word in a sentence", 7)], "t string, l int")
    mix = C.Mixture([C.SourceSpec("own", own, "t", "l", policy="own"),
                     C.SourceSpec("added", added, "t", "l", policy="stratify", id_col="k"),
                     C.SourceSpec("only", only, "t", "l"), C.SourceSpec("off", only, "t", "l", enabled=False)])
    out = mix.build_split()
    got = Counter((r.source, r.split) for r in out.collect())
    assert got == {("own", "dev"): 1, ("own", "train"): 1, ("added", "dev"): 6, ("added", "train"): 34, ("only", "train"): 1}
    assert out.columns == ["text", "label", "source", "split"]
    shuffled = C.Mixture(mix.sources, shuffle_seed="42").build_split()
    assert sorted(r.shuffle_pos for r in shuffled.collect()) == list(range(1, 44))
    for bad in (C.SourceSpec("x", added, "t", "l", policy="stratify"), C.SourceSpec("x", added, "t", "l", policy="sample")):
        with pytest.raises(ValueError, match="x:"):
            C.Mixture([bad]).build_split()


# -- lookups beyond the broadcast bound --------------------------------------------
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("bits", [0, 64, 1 << 16])
def test_absent_keys_never_reach_the_shuffle(spark, how, bits):
    from lectio.operators import joins as J

    right = spark.range(0, 4000, 2).selectExpr("CONCAT('w', id) AS word", "id AS score")
    left = spark.range(6000).selectExpr("IF(id % 3 = 0, 'the', IF(id % 7 = 0, NULL, CONCAT('w', id % 5000))) AS word", "id AS v")
    want = Counter(map(tuple, left.join(right, "word", how).collect()))
    spark.conf.set("lectio.join.bitmapBits", str(bits))
    spark.conf.set("lectio.broadcast.maxRows", "100")
    spark.conf.set("lectio.join.hotSampleFraction", "0.2")
    spark.conf.set("lectio.join.hotKeys", "5")
    try:
        got = J.lookup_join(left, right, "word", how)
        assert Counter(map(tuple, got.collect())) == want
        marked = J.mark_absent(left, right, ["word"], bits or 64)
        present = {r.word for r in right.collect()}
        rows = marked.collect()
        assert all(r.word not in present for r in rows if r._absent)  # none is lost
        if bits == 1 << 16:  # few rows are shuffled in vain
            vain = sum(not r._absent and r.word not in present for r in rows)
            assert vain < 0.1 * sum(r.word not in present for r in rows)
    finally:
        for k in ("lectio.join.bitmapBits", "lectio.broadcast.maxRows", "lectio.join.hotSampleFraction", "lectio.join.hotKeys"):
            spark.conf.unset(k)
