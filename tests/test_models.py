"""Moment-based models and ANOVA against NumPy; nearest centroid tie rule."""
import random

import numpy as np
import pytest

from proflex.operators.comoments import merge
from proflex.operators.cvmoments import fold_moments, logistic_problems
from proflex.operators.logistic_grid import fit_logistic
from proflex.operators.models import class_moments, fit_centroids, fit_discriminant, nearest_centroid
from proflex.operators.selection import anova_f, fit_standardizer, standardize


def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        c = ["A2", "B1", "C1"][i % 3]
        mu = {"A2": 0.0, "B1": 1.0, "C1": 2.5}[c]
        rows.append((i, c, float(rng.normal(mu, 1.0)), float(rng.normal(-mu, 2.0))))
    return spark.createDataFrame(rows, "doc_id long, prof_level string, x double, y double"), rows


def test_anova_matches_numpy(spark):
    df, rows = data(spark)
    got = {r.feature: r.f_score for r in anova_f(df, ["x", "y"]).collect()}
    for j, f in ((2, "x"), (3, "y")):
        groups = [np.array([r[j] for r in rows if r[1] == c]) for c in ("A2", "B1", "C1")]
        allv = np.concatenate(groups)
        ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[f] == pytest.approx((ssb / 2) / (ssw / (len(allv) - 3)), rel=1e-9)


def test_standardize_population_sd(spark):
    df, rows = data(spark)
    p = fit_standardizer(df, ["x"])
    xs = np.array([r[2] for r in rows])
    assert p["x"][0] == pytest.approx(xs.mean()) and p["x"][1] == pytest.approx(xs.std())
    out = standardize(df, p).agg({"x": "avg"}).first()[0]
    assert abs(out) < 1e-9


def test_lda_one_feature(spark):
    df, rows = data(spark)
    pred = fit_discriminant(df, ["x"])
    got = [r[0] for r in df.select(pred).collect()]
    xs = np.array([r[2] for r in rows])
    labels = np.array([r[1] for r in rows])
    cls = sorted(set(labels))
    means = {c: xs[labels == c].mean() for c in cls}
    var = sum(((xs[labels == c] - means[c]) ** 2).sum() for c in cls) / (len(xs) - len(cls))
    prior = {c: (labels == c).mean() for c in cls}
    expect = [max(cls, key=lambda c: (x * means[c] / var - means[c] ** 2 / (2 * var) + np.log(prior[c]), -ord(c[0])))
              for x in xs]
    assert got == expect
    n, mean, scatter = class_moments(df, ["x"])["A2"]
    own = xs[labels == "A2"]
    assert n == 100 and mean[0] == pytest.approx(own.mean()) and scatter[0, 0] == pytest.approx(((own - own.mean()) ** 2).sum())


def test_nearest_centroid_ties_to_smaller_label(spark):
    df = spark.createDataFrame([(0, "B1", 1.0), (1, "A2", -1.0), (2, "B1", 0.0)],
                               "doc_id long, prof_level string, x double")
    cents = {"A2": [-1.0], "B1": [1.0]}
    got = [r[0] for r in df.orderBy("doc_id").select(nearest_centroid(cents, ["x"])).collect()]
    assert got == ["B1", "A2", "A2"]
    assert set(fit_centroids(df, ["x"])) == {"A2", "B1"}


def test_comoments_with_large_means(spark):
    """51 features whose means are 10^8 times their deviations, which raw sums of squares lose."""
    rng = np.random.default_rng(5)
    x = 1e8 + rng.normal(size=(400, 51)) @ rng.normal(size=(51, 51))
    names = [f"f{i}" for i in range(51)]
    rows = spark.createDataFrame([("ab"[i % 2], i % 3, *map(float, r)) for i, r in enumerate(x)],
                                 "prof_level string, fold int, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    got = fold_moments(rows, names)
    assert len(got) == 6
    for (fold, c), (n, mean, scatter) in got.items():
        own = x[[i for i in range(400) if i % 3 == fold and "ab"[i % 2] == c]]
        assert n == len(own)
        np.testing.assert_allclose(mean, own.mean(0), rtol=1e-14)
        np.testing.assert_allclose(scatter, (own - own.mean(0)).T @ (own - own.mean(0)), atol=1e-3)
        assert merge(None, (n, mean, scatter))[0] == n


def test_logistic_grid_equals_single_fits(spark):
    """All folds and sizes together against Newton steps on each training set."""
    rng = np.random.default_rng(3)
    names, classes = ["a", "b", "c", "d"], ["A2", "B1", "C1"]
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) * [1, 50, 0.01, 3] + np.outer(y, [1.0, 20, 0.001, 0]) + [0, 1000, 0, 5]
    fold = np.arange(240) % 3
    df = spark.createDataFrame([(classes[c], int(f), *map(float, r)) for c, f, r in zip(y, fold, x)],
                               "prof_level string, fold int, a double, b double, c double, d double").repartition(5)
    mom = fold_moments(df, names)
    sized = logistic_problems(mom, names, [2, 4], c=0.7)
    fitted = fit_logistic(df, names, classes, [p for _, p in sized], fold="fold")
    assert len(fitted) == 6 and all(p.converged for p in fitted)
    for p in fitted:
        mine = fold != p.fold
        z = np.column_stack([((x[mine] - x[mine].mean(0)) / x[mine].std(0)) * p.mask, np.ones(mine.sum())])
        hot, w = np.eye(3)[y[mine]], np.zeros((3, 5))
        ridge = np.diag(np.tile([1.0] * 4 + [0.0], 3)) / 0.7
        for _ in range(50):
            s = np.exp(z @ w.T - (z @ w.T).max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            g = ((s - hot).T @ z).ravel() + ridge @ w.ravel()
            h = ridge + np.block([[(z.T * (s[:, i] * ((i == j) - s[:, j]))) @ z for j in range(3)] for i in range(3)])
            w -= (np.linalg.pinv(h) @ g).reshape(3, 5)
        raw, b = p.raw()
        centred = w - w.mean(0)        # shares do not change when all classes move alike
        np.testing.assert_allclose(p.weights - p.weights.mean(0), centred, atol=2e-4)
        np.testing.assert_allclose(x @ raw.T + b, np.column_stack([(x - p.mean) / p.sd, np.ones(240)]) @ p.weights.T, atol=1e-8)


def test_penalty_and_logistic_model(spark):
    """The fitted column separates clear classes, and a tiny C loses against a usual one."""
    from proflex.operators.models import CV_PENALTIES, choose_penalty, fit_logistic_model
    rng = np.random.default_rng(8)
    y = np.arange(150) % 3
    x = np.column_stack([y - 1 + rng.normal(0, 0.25, 150), rng.normal(size=150)])
    df = spark.createDataFrame([(i, "abc"[c], float(p), float(q)) for i, (c, (p, q)) in enumerate(zip(y, x))]
                               + [(900, "a", None, 0.0), (901, None, 0.0, 0.0)], "doc_id long, prof_level string, x double, y double")
    got = df.select("doc_id", "prof_level", fit_logistic_model(df, ["x", "y"]).alias("g")).collect()
    assert np.mean([r.prof_level == r.g for r in got if r.doc_id < 900]) > 0.9
    assert {r.doc_id: r.g for r in got}[900] is None
    c, scores = choose_penalty(df, ["x", "y"], penalties=[CV_PENALTIES[0], 1.0], folds=3)
    assert len(scores) == 2 and scores[1] > 0.9 and c == (1.0 if scores[1] > scores[0] else CV_PENALTIES[0])


@pytest.mark.parametrize("balanced", [False, True])
def test_permutation_importance(spark, balanced):
    """Against permuting the column and scoring every row anew; ids far apart, one range crowded."""
    import hashlib
    from proflex.operators.models import AdditiveModel, permutation_importance
    rng = np.random.default_rng(6)
    ids = [*range(100, 340), 10 ** 9, 5 * 10 ** 9, -7]
    y = rng.choice(3, len(ids), p=[0.6, 0.3, 0.1])
    x = np.column_stack([y + rng.normal(0, 0.6, len(ids)), y * 0.3 + rng.normal(size=len(ids)), rng.normal(size=len(ids))])
    df = spark.createDataFrame([(k, "abc"[c], *map(float, r)) for k, c, r in zip(ids, y, x)],
                               "doc_id long, prof_level string, u double, v double, w double").repartition(4)
    names = ["u", "v", "w"]
    cents = fit_centroids(df, names)
    got = {r.feature: r for r in permutation_importance(df, names, AdditiveModel.of_centroids(cents), 3, 5, balanced=balanced).collect()}
    means = np.array([cents[c] for c in "abc"])

    def score(rows):
        hit = ((rows[:, None] - means) ** 2).sum(2).argmin(1) == y
        return np.mean([hit[y == c].mean() for c in range(3)]) if balanced else hit.mean()
    by_key = np.argsort(ids)
    for f, name in enumerate(names):
        drops = []
        for r in range(3):
            order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"5:{r}:{name}:{ids[i]}".encode()).hexdigest(), ids[i]))
            moved = x.copy()
            moved[by_key, f] = x[order, f]
            drops.append(score(x) - score(moved))
        assert got[name].importance_mean == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[name].importance_sd == pytest.approx(np.std(drops), abs=1e-9)


def test_additive_linear_model(spark):
    from proflex.operators.models import AdditiveModel
    from pyspark.sql import functions as F
    m = AdditiveModel(["p", "q"], [[0.0, 0.0]] * 2, [[0.0, 0.0]] * 2, [[-1.0, 2.0], [3.0, 0.5]], [0.0, 1.0])
    row = spark.range(1).select(*[(m.term(c, 0, F.lit(2.0)) + m.term(c, F.lit(1), F.lit(4.0)) + m.offset[c]).alias(f"c{c}") for c in range(2)])
    assert tuple(row.first()) == (6.0, 9.0)
    assert row.select(m.winner([F.col("c0"), F.col("c1")])).first()[0] == "p"


def test_range_rank(spark):
    from proflex.operators.sampling import range_rank
    keys = [None, *range(50), *range(10 ** 6, 10 ** 6 + 1000, 7), -3]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = [(r.k, r["rank"]) for r in range_rank(df, "k", buckets=8).collect()]
    want = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted(got, key=lambda r: r[1]) == [(k, i + 1) for i, k in enumerate(want)]
    assert range_rank(df.limit(0), "k").count() == 0


def test_forest_rows_keep_their_nodes(spark):
    """Else each level of the trees sends the whole forest to every task; the forest itself is the same."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from proflex.operators.models import estimator
    rng = random.Random(8)
    rows = [(rng.random(), rng.random(), rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, label string").coalesce(2)
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    df = StringIndexer(inputCol="label", outputCol="label_idx").fit(df).transform(df).persist()
    forest = estimator("random_forest", 2)
    assert forest.getCacheNodeIds() and forest.getNumTrees() == 100 and forest.getMaxDepth() == 30
    few = forest.copy({forest.numTrees: 5})
    assert few.fit(df).toDebugString.split("\n")[1:] == few.copy({few.cacheNodeIds: False}).fit(df).toDebugString.split("\n")[1:]
