"""One machine for each pair of classes over kernel features."""
import numpy as np

from proflex.operators.pairwise_svm import DIM, fit_pairwise, fourier


def rings(spark, n=360, seed=2):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.array([0.2, 1.2, 2.4])[y] + rng.normal(0, 0.08, n)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    rows = [(i, "abc"[c], float(p), float(q)) for i, (c, (p, q)) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "doc_id long, prof_level string, p double, q double").repartition(5), x, y


def test_rings_and_seed(spark):
    df, x, y = rings(spark)
    one = fit_pairwise(df, ["p", "q"], c=10.0)
    assert one.converged and one.pairs == [(0, 1), (0, 2), (1, 2)]
    got = df.select("prof_level", one.column(["p", "q"]).alias("g")).collect()
    assert np.mean([r.prof_level == r.g for r in got]) > 0.97        # no line divides rings
    again = fit_pairwise(df, ["p", "q"], c=10.0)
    np.testing.assert_allclose(one.weights, again.weights, atol=1e-3)
    assert not np.allclose(one.project, fit_pairwise(df, ["p", "q"], seed=1, max_iter=1).project)


def test_each_pair_is_its_own_optimum(spark):
    """The gradient of each pair's objective, from the rows of its two classes alone, vanishes."""
    df, x, y = rings(spark, 240)
    m = fit_pairwise(df, ["p", "q"], c=2.0)
    z = fourier(x, m.project, m.phase)
    for (a, b), w in zip(m.pairs, m.weights):
        mine = (y == a) | (y == b)
        s = np.where(y[mine] == a, 1.0, -1.0)
        short = np.maximum(1 - s * (z[mine] @ w), 0)
        pull = w.copy()
        pull[-1] = 0
        assert np.abs(pull - 2 * 2.0 * (s * short) @ z[mine]).max() / (2.0 * mine.sum()) < 1e-4


def test_kernel_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    big = 20000
    z = fourier(x, rng.normal(0, np.sqrt(2 / 3), (big, 3)), rng.uniform(0, 2 * np.pi, big))[:, :-1]
    gram = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 3)
    assert np.abs(z @ z.T - gram).max() < 0.05
    schema = "doc_id long, prof_level string, p double"
    rows = [(0, "a", 1.0), (1, "b", -1.0), (2, "a", None), (3, None, 5.0), (4, "b", float("nan"))]
    df = spark.createDataFrame(rows, schema)
    got = {r[0]: r[1] for r in df.select("doc_id", fit_pairwise(df, ["p"]).column(["p"])).collect()}
    assert got[0] == "a" and got[1] == "b" and got[2] is None and got[4] is None
    single = fit_pairwise(df.where("prof_level = 'a'"), ["p"])
    assert single.weights.shape == (0, DIM + 1)
    assert [r[0] for r in df.where("doc_id < 2").select(single.column(["p"])).collect()] == ["a", "a"]
