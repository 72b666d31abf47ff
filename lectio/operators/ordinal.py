"""Ordinal regression by a cumulative-link model (M5).

One weight vector w and ordered cut points: P(level <= k) = s(cut_k - w.x) with
the logistic s.  A row's level is the one with as many cut points below w.x, the
median of its distribution.  Levels that the training rows lack get no cut point
of their own; a row can't get such a level.

*Dense features* (:func:`fit_ordinal`): a fixed number of Newton steps.  A step's
gradient and Hessian are sums over the rows by level (no row reaches the driver,
one row per level does), and the small system is solved there.

*Texts* (:func:`fit_ordinal_text`): hashed words as sparse rows, stored once as
blocks; L-BFGS, whose gradient every task sums over its blocks before one
aggregation by feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectio.functions import text as T
from lectio.session import stored_rows

#: Probabilities below this count as this, so that a far-off row stays finite.
LEAST_P = 1e-12


@dataclass
class OrdinalModel:
    """``levels`` in order, one cut point fewer, and the weights of the
    standardised features ``(x - mean) / std``."""
    levels: list[int]
    cuts: np.ndarray
    weights: np.ndarray
    names: list[str]
    mean: np.ndarray
    std: np.ndarray

    def score(self) -> Column:
        """w.x as an expression over the feature columns."""
        total = F.lit(0.0)
        for name, w, m, s in zip(self.names, self.weights, self.mean, self.std):
            total = total + F.lit(float(w)) * ((F.col(name).cast("double") - F.lit(float(m))) / F.lit(float(s)))
        return total

    def level(self, score: Column | None = None) -> Column:
        return level_of(self.score() if score is None else score, self.cuts, self.levels)

    def predict(self, df: DataFrame, keep: list[str], out: str = "level") -> DataFrame:
        """M8: ``keep`` and the level of every row; null where a feature is."""
        return df.select(*keep, self.level().alias(out))


def level_of(score: Column, cuts: np.ndarray, levels: list[int]) -> Column:
    """The level with as many cut points below the score."""
    place = F.lit(1)
    for c in cuts.tolist():
        place = place + F.when(score > F.lit(c), 1).otherwise(0)
    return F.when(score.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in levels]), place)).cast("int")


def start_cuts(counts: np.ndarray) -> np.ndarray:
    """Logits of the cumulative shares: the fit without features."""
    below = np.cumsum(counts)[:-1]
    total = counts.sum()
    return np.log((below + 0.5) / (total - below + 0.5))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _parts(rows: DataFrame, names: list[str], cuts: np.ndarray, weights: np.ndarray) -> DataFrame:
    """First and second derivatives of each row's log likelihood by its upper
    cut point (u), its lower one (l) and its score (e)."""
    k = len(cuts) + 1
    y, eta = F.col("_y"), F.lit(0.0)
    for name, w in zip(names, weights.tolist()):
        eta = eta + F.lit(w) * F.col(name)
    table = F.array(*[F.lit(c) for c in cuts.tolist()])
    rows = rows.withColumn("_eta", eta)
    up = _sigmoid(F.element_at(table, F.least(y, F.lit(k - 1))) - F.col("_eta"))
    low = _sigmoid(F.element_at(table, F.greatest(y - 1, F.lit(1))) - F.col("_eta"))
    rows = rows.withColumn("_fu", F.when(y == k, 1.0).otherwise(up)).withColumn("_fl", F.when(y == 1, 0.0).otherwise(low))
    fu, fl = F.col("_fu"), F.col("_fl")
    rows = rows.withColumn("_p", F.greatest(fu - fl, F.lit(LEAST_P)))
    p, du, dl = F.col("_p"), fu * (1 - fu), fl * (1 - fl)
    rows = rows.select("_y", *names, (du / p).alias("_a"), (dl / p).alias("_b"),
                       (du * (1 - 2 * fu) / p).alias("_a2"), (dl * (1 - 2 * fl) / p).alias("_b2"))
    a, b = F.col("_a"), F.col("_b")
    rows = rows.select("_y", *names, a.alias("_u"), (-b).alias("_l"), (F.col("_a2") - a * a).alias("_uu"),
                       (-F.col("_b2") - b * b).alias("_ll"), (a * b).alias("_ul"))
    uu, ll, ul = F.col("_uu"), F.col("_ll"), F.col("_ul")
    return rows.withColumns({"_e": -(F.col("_u") + F.col("_l")), "_ee": uu + 2 * ul + ll, "_eu": -(uu + ul), "_el": -(ul + ll)})


def newton_system(rows: DataFrame, names: list[str], cuts: np.ndarray, weights: np.ndarray,
                  reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Negative Hessian and gradient at (weights, cuts), ridge included.
    ``rows``: standardised features and ``_y``, the level's place from 1."""
    d, k = len(names), len(cuts) + 1
    sums = {c: F.sum(c) for c in ("_u", "_l", "_uu", "_ll", "_ul")}
    for i, a in enumerate(names):
        sums |= {f"e{i}": F.sum(F.col("_e") * F.col(a)), f"u{i}": F.sum(F.col("_eu") * F.col(a)),
                 f"l{i}": F.sum(F.col("_el") * F.col(a))}
        sums |= {f"h{i}_{j}": F.sum(F.col("_ee") * F.col(a) * F.col(names[j])) for j in range(i, d)}
    found = _parts(rows, names, cuts, weights).groupBy("_y").agg(*[c.alias(n) for n, c in sums.items()]).collect()
    h, g = np.zeros((d + k - 1, d + k - 1)), np.zeros(d + k - 1)
    for r in found:  # one row per level
        y = r["_y"]
        upper, lower = d + y - 1, d + y - 2  # places of its cut points
        for i in range(d):
            g[i] += r[f"e{i}"]
            for j in range(i, d):
                h[i, j] += r[f"h{i}_{j}"]
            if y < k:
                h[i, upper] += r[f"u{i}"]
            if y > 1:
                h[i, lower] += r[f"l{i}"]
        if y < k:
            g[upper] += r["_u"]
            h[upper, upper] += r["_uu"]
        if y > 1:
            g[lower] += r["_l"]
            h[lower, lower] += r["_ll"]
        if 1 < y < k:
            h[lower, upper] += r["_ul"]
    h = np.triu(h) + np.triu(h, 1).T
    g[:d] -= reg * weights
    return np.diag([reg] * d + [0.0] * (k - 1)) - h, g


def fit_ordinal(train: DataFrame, names: list[str], label_col: str = "label", steps: int = 6,
                reg: float = 1.0) -> OrdinalModel:
    """M5 on feature columns: ``steps`` Newton steps from the cumulative
    shares, with ridge ``reg`` on the standardised weights.  Rows without a
    label or with a null feature are left out."""
    rows = train.select(F.col(label_col).cast("int").alias("_label"), *[F.col(n).cast("double") for n in names]).dropna()
    moments = [F.count(F.lit(1)).alias("n")]
    moments += [f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    stats = rows.agg(*moments).first()
    if not stats["n"]:
        raise ValueError("no row has a label and all features")
    mean = np.array([stats[f"mean_{n}"] for n in names])
    std = np.array([stats[f"std_{n}"] or 1.0 for n in names])
    counted = sorted((r["_label"], r["count"]) for r in rows.groupBy("_label").count().collect())  # one row per level
    levels = [v for v, _ in counted]
    place = F.lit(0)
    for v in levels:
        place = place + F.when(F.col("_label") >= v, 1).otherwise(0)
    z = [((F.col(n) - F.lit(m)) / F.lit(s)).alias(n) for n, m, s in zip(names, mean.tolist(), std.tolist())]
    rows = rows.select(place.alias("_y"), *z).persist()
    weights, cuts = np.zeros(len(names)), start_cuts(np.array([c for _, c in counted], float))
    try:
        for _ in range(steps if len(levels) > 1 else 0):
            h, g = newton_system(rows, names, cuts, weights, reg)
            step = np.linalg.solve(h, g)
            weights, cuts = weights + step[:len(names)], cuts + step[len(names):]
    finally:
        rows.unpersist()
    return OrdinalModel(levels, cuts, weights, list(names), mean, std)


# -- texts -----------------------------------------------------------------------
def hashed_words(text_col: str, features: int) -> Column:
    """The places of a text's lower-cased words among ``features``."""
    return F.transform(T.whitespace_tokens(F.lower(F.col(text_col))), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


@dataclass
class OrdinalTextModel:
    levels: list[int]
    cuts: np.ndarray
    weights: np.ndarray
    text_col: str

    def predict(self, df: DataFrame, keep: list[str], out: str = "level") -> DataFrame:
        """M8: levels from the mean weight of a text's words.  Every worker
        gets the weights with the task; rows come in Arrow batches."""
        weights, cuts, levels = self.weights, self.cuts, np.array(self.levels, np.int32)
        rows = df.select(*keep, F.coalesce(hashed_words(self.text_col, len(weights)), F.array()).alias("_words"))
        schema = df.select(*keep).schema.add(out, ST.IntegerType())

        def run(it):
            for b in it:
                score = _scores(*_sparse(b.column(b.num_columns - 1)), weights)
                level = levels[np.searchsorted(cuts, score, side="left")]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(level)], schema.names)

        return rows.mapInArrow(run, schema)


def _sparse(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as CSR: row bounds and columns."""
    ptr = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return ptr, lists.flatten().to_numpy()


def _scores(ptr: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), n)
    return np.bincount(row, weights=weights[cols], minlength=len(n)) / np.maximum(n, 1)


def link_gradient(y: np.ndarray, score: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, its derivative by each row's score and by the cuts
    (``y``: places of the levels, from 0)."""
    wide = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(over="ignore"):
        fu, fl = (1 / (1 + np.exp(score - wide[y + i])) for i in (1, 0))
    p = np.maximum(fu - fl, LEAST_P)
    du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
    by_cut = np.bincount(y, weights=du, minlength=len(cuts) + 1)[:-1] - np.bincount(y, weights=dl, minlength=len(cuts) + 1)[1:]
    return float(np.log(p).sum()), dl - du, by_cut


def lbfgs(value_and_gradient, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise by L-BFGS: two-loop recursion, halving the step until the
    value falls."""
    value, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        size = 1.0 if pairs else 1.0 / max(np.abs(g).max(), 1e-12)
        for _ in range(20):
            new = x - size * q
            new_value, new_g = value_and_gradient(new)
            if new_value < value:
                break
            size /= 2
        else:
            return x
        if (new - x) @ (new_g - g) > 1e-12:
            pairs = (pairs + [(new - x, new_g - g)])[-memory:]
        x, value, g = new, new_value, new_g
    return x


def fit_ordinal_text(train: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 14,
                     steps: int = 20, reg: float = 1e-4) -> OrdinalTextModel:
    """M5 on texts: weights of ``features`` hashed words (a text's score is
    their mean) and the cut points.  Cut points stay in order: their distances
    are fitted as logarithms.  Rows without a label are left out; a null text
    has no words."""
    rows = train.select(F.col(label_col).cast("int").alias("_label"),
                        F.coalesce(hashed_words(text_col, features), F.array()).alias("_words")).filter("_label IS NOT NULL")
    rows = stored_rows(rows, "train-rows")
    counted = sorted((r["_label"], r["count"]) for r in rows.groupBy("_label").count().collect())
    levels = np.array([v for v, _ in counted], np.int64)
    if not len(levels):
        raise ValueError("no row has a label")
    total = float(sum(c for _, c in counted))

    def value_and_gradient(x):
        weights, first, gaps = x[:features], x[features], np.exp(x[features + 1:])
        cuts = np.cumsum(np.concatenate([[first], gaps]))

        def run(it):
            out = np.zeros(features + len(cuts) + 1)
            for b in it:
                ptr, cols = _sparse(b.column(1))
                score = _scores(ptr, cols, weights)
                like, by_score, by_cut = link_gradient(np.searchsorted(levels, b.column(0).to_numpy()), score, cuts)
                n = np.diff(ptr)
                out[:features] += np.bincount(cols, weights=np.repeat(by_score / np.maximum(n, 1), n), minlength=features)
                out[features:-1] += by_cut
                out[-1] += like
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "v"])

        sums = np.zeros(features + len(cuts) + 1)
        for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r["at"]] = r["v"]  # at most one row per feature and cut point
        by_cut = np.cumsum(sums[features:-1][::-1])[::-1]  # a gap moves all cut points after it
        g = -np.concatenate([sums[:features], by_cut[:1], by_cut[1:] * gaps]) / total
        g[:features] += reg * weights
        return -sums[-1] / total + reg / 2 * float(weights @ weights), g

    if len(levels) == 1:
        return OrdinalTextModel(levels.tolist(), np.empty(0), np.zeros(features), text_col)
    cuts = start_cuts(np.array([c for _, c in counted], float))
    x = np.concatenate([np.zeros(features), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-6))])
    x = lbfgs(value_and_gradient, x, steps)
    return OrdinalTextModel(levels.tolist(), np.cumsum(np.concatenate([x[features:features + 1], np.exp(x[features + 1:])])),
                            x[:features], text_col)
