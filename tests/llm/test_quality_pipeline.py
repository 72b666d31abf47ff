"""The quality classifier and the corpus pipeline; SQL twins of the queries."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectio.llm import bpe, quality, queries, substring
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import SCHEMA, TEXTS
from tests.llm.test_bpe import JSON, _check_pieces
from tests.llm.test_text_operators import fold, jaccard_groups, removed


def test_em_finds_the_accuracies_of_the_labellers():
    rng = np.random.default_rng(4)
    n, good = 40_000, 0.7
    truth = rng.random(n) < good
    miss = np.array([0.7, 0.5, 0.3, 0.6, 0.4])  # share of bad documents that a labeller calls good
    alarm = np.array([0.01, 0.015, 0.002, 0.005, 0.01])
    bad = np.where(truth[:, None], rng.random((n, 5)) < alarm, rng.random((n, 5)) >= miss)
    votes = np.where(bad, quality.BAD, quality.GOOD)
    votes[rng.random((n, 5)) < 0.2] = quality.NONE
    codes, counts = np.unique(votes @ (3 ** np.arange(4, -1, -1)), return_counts=True)
    posterior, shares, share = quality.expectation_maximisation(quality.unpack(codes, 5), counts)
    assert share == pytest.approx(good, abs=0.02)
    assert shares[:, 0, quality.GOOD] == pytest.approx(miss, abs=0.05)
    assert shares[:, 1, quality.BAD] == pytest.approx(alarm, abs=0.01)
    assert ((posterior >= 0) & (posterior <= 1)).all()


def test_em_with_a_labeller_above_the_alarm_bound():
    """Its share is held at the bound, the README says at what cost."""
    rng = np.random.default_rng(4)
    n = 40_000
    truth = rng.random(n) < 0.7
    alarm = np.array([0.1, 0.015, 0.002, 0.005, 0.01])
    bad = np.where(truth[:, None], rng.random((n, 5)) < alarm, rng.random((n, 5)) >= np.array([0.7, 0.5, 0.3, 0.6, 0.4]))
    votes = np.where(bad, quality.BAD, quality.GOOD)
    votes[rng.random((n, 5)) < 0.2] = quality.NONE
    codes, which, counts = np.unique(votes @ (3 ** np.arange(4, -1, -1)), return_inverse=True, return_counts=True)
    posterior, shares, share = quality.expectation_maximisation(quality.unpack(codes, 5), counts)
    good = posterior[which] >= 0.5
    assert shares[0, 1, quality.BAD] == quality.MAX_FALSE_ALARM and share == pytest.approx(0.647, abs=0.01)
    assert (~good[truth]).mean() == pytest.approx(0.065, abs=0.01) and good[~truth].mean() == pytest.approx(0.072, abs=0.01)


def test_held_out_labels(spark):
    """Nothing is fitted on the labels."""
    rows = queries.op10_weak_label_quality(spark, SF_MID)
    assert rows.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    counts = {(r.quality, r.kept): r["count"] for r in rows.join(
        spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts[1, True] / (counts[1, True] + counts.get((1, False), 0)) > 0.99
    assert counts[0, False] / (counts[0, False] + counts.get((0, True), 0)) > 0.9


def test_quality_of_odd_rows(odd, empty):
    scorer = quality.train(odd)
    rows = quality.score(odd, scorer).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by_id[i].score == 0.0 and not by_id[i].kept for i in (2, 3, 4))
    kept = quality.keep_good(odd, scorer)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    again = quality.score(odd.repartition(5), quality.train(odd.repartition(2))).collect()
    assert {(r.doc_id, r.votes, r.kept) for r in again} == {(r.doc_id, r.votes, r.kept) for r in rows}
    nothing = quality.train(empty)
    assert quality.score(empty, nothing).count() == 0 == quality.keep_good(empty, nothing).count()


def _through(spark, docs, steps):
    """The rows that enter and leave each stage."""
    from lectio.llm.common import stage
    for name, step in steps:
        out = stage(step(spark, docs, SF_SMALL), "test-stage")
        yield name, docs, out
        docs = out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, before, after in _through(spark, docs, corpus_pipeline.STAGES):
        a = [(r.doc_id, r.text) for r in before.collect()]
        got = after.collect()
        if name != "packing":
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            b = sorted((r.doc_id, r.text) for r in got)
        if name == "quality classifier":
            scored = quality.classify(before).filter("kept").select("doc_id").collect()
            assert [i for i, _ in b] == sorted(r.doc_id for r in scored) and set(b) <= set(a)
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(a):
                first.setdefault(fold(t), i)
            assert b == [(i, t) for i, t in sorted(a) if first[fold(t)] == i]
        elif name == "n-gram Jaccard join":
            stay = {i for i, _, c in jaccard_groups(a) if i == c}
            assert b == [(i, t) for i, t in sorted(a) if i in stay]
        elif name == "substring dedup":
            gone = {i: (n, kept) for i, _, n, kept in removed(a, 13)}
            assert b == [(i, gone[i][1] if gone[i][0] else t) for i, t in sorted(a)]
            assert all(r.n_chars == len(r.text) for r in got)
        else:
            pieces = _check_pieces(got, 1024)
            enc = bpe.encoder(JSON)
            for i, t in a:
                ids = b"".join(bytes(p.ids) for p in sorted(pieces.pop(i), key=lambda p: p.start))
                assert ids == np.append(enc.encode(t or ""), 0).astype("<u4").tobytes()
            assert not pieces


def test_stages_on_odd_and_no_rows(spark, odd, empty):
    columns = [F.col("doc_id"), F.col("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
               F.char_length("text").cast("long").alias("n_chars"), F.lit(1).alias("gone_id"), F.lit(2).alias("id")]
    for rows in (odd.select(*columns), empty.select(*columns)):
        for name, step in corpus_pipeline.STAGES[1:]:
            out = step(spark, rows, SF_SMALL)
            n = out.count()
            assert (n == 0) == (rows.count() == 0)
            if name != "packing":
                assert out.columns == rows.columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF_SMALL)
    found = duck.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in rows.collect()) == sorted(found.fetchall())


def test_registered_queries_are_complete():
    from __spark_entry__ import oracle_sql, queries as registered
    names = registered()
    assert {int(m[1]) for m in map(re.compile(r"op(\d+)_").match, names) if m} == set(range(1, 11))
    assert "pipeline" in names and set(oracle_sql()) <= set(names)



def test_other_text_of_a_near_copys_id_stays(spark):
    long = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(long)), (5, " ".join([*long[:-1], "new"])), (5, " ".join(f"v{i}" for i in range(60))), (None, " ".join(long))]
    kept = corpus_pipeline.dissimilar(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {tuple(r) for r in kept.collect()} == {docs[0], docs[2], docs[3]}


def test_steps_without_an_encoder_drop_it(spark):
    def run(it):
        bpe.encoder(JSON).encode("a text")
        rows = [r for part in substring._by_slices(it) for r in part]
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([bpe.encoder.cache_info().currsize])], ["n", "kept"])

    src = spark.createDataFrame([(1, "one"), (2, "two")], "id long, text string").coalesce(1)
    assert src.mapInArrow(run, "n long, kept long").collect() == [(2, 0)]
