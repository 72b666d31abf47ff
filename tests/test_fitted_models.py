"""Ordinal regression, naive Bayes and ridge models against NumPy and plain
Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from lectio.operators import bayes as B
from lectio.operators import gram as G
from lectio.operators import metrics as M
from lectio.operators import ordinal as OR
from lectio.session import scratch_path


# -- cumulative link --------------------------------------------------------------
def ordinal_data(n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(5, 2, n), rng.exponential(3, n), np.full(n, 4.0)])
    noise = rng.logistic(0, 1, n)
    score = 1.5 * (x[:, 0] - 5) / 2 - 0.8 * (x[:, 1] - 3) / 3 + noise
    level = np.searchsorted([-1.5, 0.0, 0.2, 2.0], score) * 2 + 3  # 3, 5, 7, 9, 11
    return x, level


def numpy_ordinal(x, level, steps, reg):
    """The same Newton steps by finite loops over the rows."""
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    levels, y = np.unique(level, return_inverse=True)
    k, d = len(levels), x.shape[1]
    below = np.cumsum(np.bincount(y))[:-1]
    par = np.concatenate([np.zeros(d), np.log((below + 0.5) / (len(y) - below + 0.5))])

    def value(par):
        cuts = np.concatenate([[-np.inf], par[d:], [np.inf]])
        eta = z @ par[:d]
        p = 1 / (1 + np.exp(eta - cuts[y + 1])) - 1 / (1 + np.exp(eta - cuts[y]))
        return np.log(np.maximum(p, OR.LEAST_P)).sum() - reg / 2 * (par[:d] ** 2).sum()

    def derivative(f, at, i, e):
        step = np.zeros(len(at))
        step[i] = e
        return (f(at + step) - f(at - step)) / (2 * e)

    for _ in range(steps):
        g = np.array([derivative(value, par, i, 1e-5) for i in range(d + k - 1)])
        h = np.array([[derivative(lambda q: derivative(value, q, i, 1e-4), par, j, 1e-4) for j in range(d + k - 1)]
                      for i in range(d + k - 1)])
        par = par + np.linalg.solve(-h, g)
    return levels, par[:d], par[d:], z


def test_newton_equals_numpy(spark):
    x, level = ordinal_data()
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, level))],
                               "id long, a double, b double, c double, label int").repartition(5)
    model = OR.fit_ordinal(df, ["a", "b", "c"], steps=4, reg=1.0)
    levels, weights, cuts, z = numpy_ordinal(x, level, 4, 1.0)
    assert model.levels == levels.tolist()
    assert np.allclose(model.weights, weights, atol=1e-3) and np.allclose(model.cuts, cuts, atol=1e-3)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.id: r.level for r in model.predict(df, ["id"]).collect()}
    want = levels[np.searchsorted(model.cuts, z @ model.weights)]
    assert [got[i] for i in range(len(want))] == want.tolist()
    assert M.qwk(df.join(model.predict(df, ["id"]), "id").select(F.col("label").alias("gold"), F.col("level").alias("pred"))
                 ).first().qwk > 0.5


def test_ordinal_on_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 3), (None, 4), (3.0, None)], "a double, label int")
    model = OR.fit_ordinal(df, ["a"])
    assert sorted(str(r.level) for r in model.predict(df, []).collect()) == ["3", "3", "3", "None"]
    with pytest.raises(ValueError, match="no row"):
        OR.fit_ordinal(df.limit(0), ["a"])


def test_link_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    y, score, cuts = rng.integers(0, 4, 50), rng.normal(size=50), np.array([-1.0, 0.1, 0.9])
    _, by_score, by_cut = OR.link_gradient(y, score, cuts)
    for i in range(3):
        step = np.zeros(50)
        step[i] = 1e-6
        slope = (OR.link_gradient(y, score + step, cuts)[0] - OR.link_gradient(y, score - step, cuts)[0]) / 2e-6
        assert slope == pytest.approx(by_score[i], abs=1e-5)
        move = np.zeros(3)
        move[i] = 1e-6
        slope = (OR.link_gradient(y, score, cuts + move)[0] - OR.link_gradient(y, score, cuts - move)[0]) / 2e-6
        assert slope == pytest.approx(by_cut[i], abs=1e-4)


def test_text_model_learns_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(900):
        top = int(rng.integers(1, 20))
        text = " ".join(rng.choice(words[:top], 12))
        rows.append((i, text, 1 + top // 4))
    rows += [(900, None, 2), (901, "", 2), (902, "unlabelled", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = OR.fit_ordinal_text(df.repartition(6), features=1 << 8, steps=30)
    other = OR.fit_ordinal_text(df.repartition(2), features=1 << 8, steps=30)
    assert np.allclose(model.weights, other.weights, atol=1e-4) and (np.diff(model.cuts) > 0).all()
    out = model.predict(df, ["id", "label"])
    assert out.count() == len(rows)
    scored = out.filter("label IS NOT NULL").select(F.col("label").alias("gold"), F.col("level").alias("pred"))
    assert M.qwk(scored).first().qwk > 0.6


# -- naive Bayes ---------------------------------------------------------------------
def plain_bayes(train, rows):
    def log(a, b):
        return math.floor(math.log(a / b) * B.SCALE + 0.5)

    train = [(t, v) for t, v in train if v is not None]
    classes = sorted({v for _, v in train})
    counts = {v: Counter(w for t, u in train if u == v for w in (t or "").lower().split()) for v in classes}
    vocabulary = {w for c in counts.values() for w in c}
    mass = {v: sum(counts[v].values()) + len(vocabulary) for v in classes}
    out = []
    for t in rows:
        known = [w for w in (t or "").lower().split() if w in vocabulary]
        score = {v: log(sum(u == v for _, u in train), len(train)) + sum(log(counts[v][w] + 1, mass[v]) for w in known)
                 for v in classes}
        out.append(max(classes, key=lambda v: (score[v], -v)))
    return out


def bayes_rows():
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["A", "b", "c", "d", "e"], rng.integers(0, 8))), int(rng.integers(1, 5))) for i in range(120)]
    rows += [(None, "a b", 2), (None, "a b", 2), (None, "c", 2), (5, "d d", 3), (5, "d d", 3), (7, None, 1), (8, "new words", 4),
             (9, "a", None)]
    return rows


def test_bayes_equals_plain_python(spark):
    rows = bayes_rows()
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    model = B.fit_bayes(df)
    got = B.bayes_levels(model, df, "text", ["id", "label"]).collect()
    want = plain_bayes([r[1:] for r in rows], [r[1] for r in rows])
    assert Counter(map(tuple, got)) == Counter((i, v, p) for (i, _, v), p in zip(rows, want))


def test_bayes_saved_and_loaded(spark):
    df = spark.createDataFrame(bayes_rows(), "id long, text string, label int")
    model = B.fit_bayes(df)
    again = B.load_bayes(spark, B.save_bayes(model, scratch_path(spark, "bayes")))
    a, b = (Counter(map(tuple, B.bayes_levels(m, df, "text", ["id"]).collect())) for m in (model, again))
    assert a == b and again.labels == model.labels
    path = scratch_path(spark, "bayes")
    B.save_bayes(model, path)
    spark.createDataFrame([(99, B.SCALE)], "version int, scale long").write.mode("overwrite").parquet(f"{path}/version")
    with pytest.raises(ValueError, match="format 99"):
        B.load_bayes(spark, path)


def test_bayes_beyond_the_broadcast_bound(spark):
    df = spark.createDataFrame(bayes_rows(), "id long, text string, label int")
    model = B.fit_bayes(df, min_count=2)
    want = Counter(map(tuple, B.bayes_levels(model, df, "text", ["id"]).collect()))
    spark.conf.set("lectio.broadcast.maxRows", "2")
    try:
        assert Counter(map(tuple, B.bayes_levels(model, df, "text", ["id"]).collect())) == want
    finally:
        spark.conf.unset("lectio.broadcast.maxRows")


# -- ridge -------------------------------------------------------------------------
def vectors(spark, n=300, d=64, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(n, d)) * scale
    f = rng.normal(size=(n, 2)) * 40
    y = np.clip(np.round(6 + 2 * e[:, 0] / scale + f[:, 1] / 30 + rng.normal(size=n) * 0.3), 1, 19).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b[0]), float(b[1]), int(v), i % 5)
                                for i, (a, b, v) in enumerate(zip(e, f, y))],
                               "id long, e array<double>, f0 double, f1 double, y long, fold int").repartition(7)
    df = df.select("id", "y", "fold", G.fixed_vector([F.col("f0"), F.col("f1")], F.col("e")).alias("x"))
    whole = np.floor(np.column_stack([np.ones(n), e, f]) * G.SCALE + 0.5).astype(object).astype(int)
    return df, whole, y


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_sums_are_exact(spark, scale):
    df, x, y = vectors(spark, d=3, scale=scale)
    found = G.systems(G.gram_sums(df, "x", "y", "fold"))
    big = x.astype(object)
    for fold in range(5):
        at = np.arange(len(y)) % 5 == fold
        assert (found[fold][0] == big[at].T @ big[at]).all() and (found[fold][1] == big[at].T @ y[at].astype(object)).all()


def test_ridge_and_folds_equal_numpy(spark):
    df, x, y = vectors(spark)
    xf = x.astype(float)
    size = np.sqrt((xf ** 2).sum(0))

    def solve(rows, reg):
        s = np.sqrt((xf[rows] ** 2).sum(0))
        a = (xf[rows] / s).T @ (xf[rows] / s) + np.diag([0.0] + [reg] * (len(s) - 1))
        return np.linalg.solve(a, (xf[rows] / s).T @ y[rows]) / s

    every = np.ones(len(y), bool)
    model = G.fit_ridge(df, "x", "y", 0.01)
    assert np.allclose(model.weights[None] * size, solve(every, 0.01) * size, rtol=1e-6, atol=1e-8)
    levels = {r.id: r.level for r in df.select("id", G.ridge_levels(model.score(None, "x")).alias("level")).collect()}
    want = np.clip(np.round(xf @ solve(every, 0.01)), 1, 19)
    assert [levels[i] for i in range(len(y))] == want.tolist()

    scores = {(r.reg, r.fold): (r.qwk, r.n) for r in G.cross_validate(df, "x", "y", "fold", [0.01, 1.0]).collect()}
    assert len(scores) == 10
    for (reg, fold), (qwk, n) in scores.items():
        held = np.arange(len(y)) % 5 == fold
        pred = np.clip(np.round(xf[held] @ solve(~held, reg)), 1, 19)
        gold = y[held]
        num, den = ((gold - pred) ** 2).mean(), (gold ** 2).mean() + (pred ** 2).mean() - 2 * gold.mean() * pred.mean()
        assert n == held.sum() and qwk == pytest.approx(1 - num / den)
    best = G.best_penalty(G.cross_validate(df, "x", "y", "fold", [0.01, 1.0])).first().reg
    assert best == max((0.01, 1.0), key=lambda r: sum(scores[r, f][0] for f in range(5)))

    models = G.fit_folds(df, "x", "y", "fold", [0.01])
    mean = np.mean([xf @ solve(np.arange(len(y)) % 5 != f, 0.01) for f in range(5)], axis=0)
    got = {r.id: r.level for r in G.ensemble(df, "x", models, ["id"]).collect()}
    assert [got[i] for i in range(len(y))] == np.clip(np.round(mean), 1, 19).tolist()


def test_rows_that_cannot_be_fitted_are_left_out(spark):
    df, _, _ = vectors(spark, d=2)
    more = df.union(spark.createDataFrame([(900, None, 1, [1000, 5, 6, 7, 8]), (901, 4, 1, None)],
                                          "id long, y long, fold int, x array<bigint>"))
    assert np.allclose(G.fit_ridge(more, "x", "y").weights[None], G.fit_ridge(df, "x", "y").weights[None])
    assert more.select(G.fit_ridge(df, "x", "y").score(None, "x").alias("s")).filter("s IS NULL").count() == 1
    with pytest.raises(ValueError, match="no row"):
        G.fit_ridge(df.limit(0), "x", "y")


def test_kappa_chooses_in_a_cross_validator(spark):
    """V4: the evaluator as the callback of Spark's own cross-validation, on
    given folds."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df, _, _ = vectors(spark, d=4)
    data = df.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"),
                     F.col("y").cast("double").alias("label"), "fold")
    lr = LinearRegression(featuresCol="features", labelCol="label", predictionCol="prediction")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 50.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=M.QWKEvaluator(), numFolds=5, foldCol="fold")
    model = cv.fit(data)
    assert len(model.avgMetrics) == 2 and model.avgMetrics[0] > model.avgMetrics[1]
    assert model.bestModel.getRegParam() == 0.0
