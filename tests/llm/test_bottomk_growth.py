"""What keeps bottom-k rounds in proportion to a growing table."""

import numpy as np
import pytest

from lectio.llm import bottomk as B


def family(rng, n, m, changed):
    """``m`` sets of about ``n`` hashes that each change a share of one base."""
    base = rng.integers(0, 1 << 63, n).astype(np.uint64)
    out = []
    for k in range(m):
        keep = base[rng.random(n) >= changed * k / m]
        out.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, n - len(keep)).astype(np.uint64)])))
    return out


def test_bounds_are_found_once():
    assert B.bounds(B.PERCENT) is B.bounds(B.PERCENT)  # formerly 18 tails anew for every list


@pytest.mark.parametrize("sizes", [(60, 90, 128), (129, 300, 2000), (100, 129, 150)])
def test_a_centre_is_estimated_like_a_pair(sizes):
    rng = np.random.default_rng(len(sizes))
    sets = [s for n in sizes for s in family(rng, n, 6, 0.5)]
    first, whole = [s[:B.SKETCH] for s in sets], np.array([len(s) <= B.SKETCH for s in sets])
    every = B.union_estimates(first, whole)
    for i in range(len(sets)):
        rest = [k for k in range(len(sets)) if k != i]
        got = B.centre_estimates(first[i], [first[k] for k in rest], whole[i], whole[rest])
        assert np.allclose(got, every[i, rest], atol=1e-6)


def test_signatures_leave_out_strangers_only():
    rng = np.random.default_rng(7)
    sets = [s for n in (30, 100, 128, 129, 160, 400, 3000) for s in family(rng, n, 12, 0.6)]
    n, first = np.array([len(s) for s in sets]), [s[:B.SKETCH] for s in sets]
    kept = B.kept_pairs(B.union_estimates(first, B._whole(n)), B._whole(n), n)
    possible = B.possible_pairs(B.signatures(first).view(np.uint64), n)
    assert possible[kept].all() and kept.sum() > len(sets)
    strangers = [np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(60)]
    maps = B.signatures([s[:B.SKETCH] for s in strangers]).view(np.uint64)
    assert B.possible_pairs(maps, np.full(60, 300)).sum() == 60  # each with itself


def test_documents_that_share_a_list_by_chance_leave_it(spark):
    rng = np.random.default_rng(5)
    near, far = family(rng, 300, 4, 0.1), [s for _ in range(20) for s in family(rng, 300, 1, 0)]
    maps = B.signatures([s[:B.SKETCH] for s in near + far])
    classes = spark.createDataFrame([(i, 300, bytearray(m.tobytes())) for i, m in enumerate(maps)], "id long, n long, sig binary")
    # list 1 holds them all, list 2 strangers, list 3 near copies of one component
    rows = [(1, 25, i, 25, i) for i in range(24)] + [(2, 25, i, 25, i) for i in range(4, 24)] + [(3, 25, 0, 25, 0), (3, 25, 1, 25, 0)]
    src = spark.createDataFrame(rows, "t long, at int, id long, own int, component long")
    for share in (512, 8):
        left = B.likely_rows(src, classes, B.PERCENT, share).collect()
        assert sorted(map(tuple, left)) == [(1, 25, i, 25) for i in range(4)]
