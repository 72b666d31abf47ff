from lectio.operators import metrics as M


def test_qwk_perfect_and_degenerate(spark):
    df = spark.createDataFrame([(1, 1), (5, 5), (9, 9), (19, 19)], "gold long, pred long")
    assert M.qwk(df).first().qwk == 1.0
    single = spark.createDataFrame([(3, 3), (3, 3)], "gold long, pred long")
    assert M.qwk(single).first().qwk is None


def _sklearn_like_qwk(y1, y2, observed=True):
    labels = sorted(set(y1) | set(y2)) if observed else list(range(1, 20))
    idx = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    n = len(y1)
    obs = [[0] * k for _ in range(k)]
    for a, b in zip(y1, y2):
        obs[idx[a]][idx[b]] += 1
    rows = [sum(r) for r in obs]
    cols = [sum(obs[i][j] for i in range(k)) for j in range(k)]
    num = sum((i - j) ** 2 * obs[i][j] for i in range(k) for j in range(k))
    den = sum((i - j) ** 2 * rows[i] * cols[j] / n for i in range(k) for j in range(k))
    return 1 - num / den


def test_qwk_modes_match_confusion_form(spark):
    gold = [1, 2, 5, 9, 19, 2, 5, 9, 1, 19, 5]
    pred = [1, 3, 5, 9, 18, 1, 9, 5, 3, 18, 5]
    df = spark.createDataFrame(list(zip(gold, pred)), "gold long, pred long")
    obs = M.qwk(df, labels="observed").first().qwk
    fix = M.qwk(df, labels="fixed").first().qwk
    assert abs(obs - _sklearn_like_qwk(gold, pred, True)) < 1e-12
    assert abs(fix - _sklearn_like_qwk(gold, pred, False)) < 1e-12
    assert abs(obs - fix) > 1e-6


def test_score_set(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (10, 12), (19, 19)], "gold long, pred long")
    r = M.score_set(df, M.equal_width_bands(spark)).first()
    assert r.acc == 50.0 and r.acc_pm1 == 75.0 and r.avg_abs_dist == 0.75
    assert r.acc_3 == 100.0
