"""Sets are made once, and rounds read only what is still open."""

import numpy as np
import pyarrow as pa

from lectio.llm import components as C
from lectio.llm import ngram_join as N
from lectio.llm.substring import _by_slices


def test_batches_become_objects_a_few_rows_at_a_time():
    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def slice(self, *at):
            return Batch(self.batch.slice(*at))

        @property
        def columns(self):
            assert self.num_rows <= 256  # formerly the whole batch
            return self.batch.columns

    rows = [(i, "w" * (i % 7)) for i in range(1000)]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "text"])
    out = list(_by_slices(iter([Batch(b)]), 500))
    assert sum(out, []) == rows and all(sum(len(r[1]) for r in part) < 500 + 7 for part in out)


def test_a_prefix_is_stored_with_its_set(spark):
    text = " ".join(f"w{i}" for i in range(60))
    src = spark.createDataFrame([(1, text), (2, ""), (3, "one two")], "id long, text string")
    own = N.shingle_sets([text.encode()])[0]
    common = np.sort(own[:10])
    table = {r.id: r for r in N._set_table(src, N.WORDS, N.PERCENT, common).collect()}
    assert np.array(table[1].prefix, np.int64).view(np.uint64).tolist() == own[10:10 + len(own) - -(-75 * len(own) // 100) + 1].tolist()
    assert table[2].prefix == [] and len(table[3].prefix) == 1


def test_a_group_says_whether_it_has_more_pairs(spark):
    sets = N.shingle_sets([" ".join(f"w{i}" for i in range(200 + k)).encode() for k in range(6)])
    rows = [(g, i, i, 0, len(sets[i]), bytearray(N.signature(sets[i]))) for g, ids in ((1, (0, 1)), (2, range(6))) for i in ids]
    df = spark.createDataFrame(rows, "g long, id long, component long, part int, n long, sig binary")
    found = N._block_candidates(df, N.PERCENT, True).collect()
    assert [r.g for r in found if r.g is not None] == [2]  # group 1's only pair is compared
    assert (0, 1) in {(r.centre, r.id) for r in found if r.g is None}
    every = N._block_candidates(df, N.PERCENT, False).collect()
    assert len(every) == 1 + 15 and all(r.g is None for r in every)


def test_only_texts_of_pairs_are_packed(spark):
    src = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string")
    pairs = spark.createDataFrame([(3, 7), (3, 9)], "centre long, id long")
    assert sorted(r.id for r in N._compressed(src, pairs).collect()) == [3, 7, 9]
    assert N._compressed(src, pairs.limit(0)).count() == 0


def test_a_group_with_few_pairs_of_components_is_compared_at_once(spark):
    # 20 documents, of which two have a component of their own: 37 pairs of 190
    sets = N.shingle_sets([" ".join(f"w{i}" for i in range(200 + k)).encode() for k in range(20)])
    rows = [(1, i, max(0, i - 17), 0, len(sets[i]), bytearray(N.signature(sets[i]))) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, id long, component long, part int, n long, sig binary")
    found = N._block_candidates(df, N.PERCENT, True).collect()
    assert len(found) == 37 and all(r.g is None for r in found)  # formerly opened again


def test_further_links_join_labels(spark):
    first = [(1, 2), (2, 3), (10, 11), (20, 21)]
    more = [(3, 11), (11, 2), (21, 30), (40, 41), (5, 41), (20, 21)]
    schema = "a long, b long"
    labels = C.joined(C.components(spark.createDataFrame(first, schema)), spark.createDataFrame(more, schema))
    want = C.components(spark.createDataFrame(first + more, schema))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.collect()))


def test_closed_classes_do_not_meet_their_documents_again(spark):
    rows = [(t, 100 * t + k, 50, 6, 1.0) for t in (1, 2) for k in range(6)]
    blocks = spark.createDataFrame(rows, "t long, id long, n long, c long, fame double")
    labels = spark.createDataFrame([], "id long, component long")
    every = N._open_groups(blocks, labels, N.PERCENT, 1).collect()
    one = next(r.g for r in every if r.id >= 200)
    left = N._open_groups(blocks, labels, N.PERCENT, 1, spark.createDataFrame([(one,)], "g long")).collect()
    assert sorted(left) == sorted(r for r in every if r.g == one)


def test_the_shingles_of_all_documents_are_counted(spark):
    # more documents than formerly were counted at most: half of these were not read
    src = spark.range(60_000, numPartitions=4).selectExpr("id", "concat('own', id, ' a b c d common words at the end') AS text")
    counts = N._slot_counts(src, N.WORDS)
    sets = N.shingle_sets([f"own{i} a b c d common words at the end".encode() for i in range(60_000)])
    want = np.bincount(N._slots(np.concatenate(sets)), minlength=N.SLOTS)
    assert counts.dtype == np.uint32 and (counts == want).all()
    row = N._set_table(src.filter("id = 7"), N.WORDS, N.PERCENT, np.empty(0, np.uint64), counts).first()
    own = N.shingle_sets([b"own7 a b c d"])[0]
    assert row.prefix[0] == own.view(np.int64)[0]  # the only shingle of one document comes first
