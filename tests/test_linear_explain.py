"""Linear explanations against Shapley values by enumeration."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from modelscout.operators import explain, prep


def expected(w, mean, cov, x, known):
    """Score of the row ``x`` expected when only ``known`` features are given, of a normal distribution."""
    known, rest = list(known), [i for i in range(len(w)) if i not in known]
    guess = mean.copy()
    if known:
        guess[known] = x[known]
        guess[rest] += cov[np.ix_(rest, known)] @ np.linalg.pinv(cov[np.ix_(known, known)], rcond=1e-9) @ (x - mean)[known]
    return w @ guess


def enumerated(w, mean, cov, x):
    d = len(w)
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            share = factorial(size) * factorial(d - size - 1) / factorial(d)
            for known in combinations(rest, size):
                out[i] += share * (expected(w, mean, cov, x, (*known, i)) - expected(w, mean, cov, x, known))
    return out


def correlated_rows(d, n=200, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + rng.standard_normal(d)


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_matrix_equals_enumeration(d):
    x = correlated_rows(d, seed=d)
    w, mean, cov = np.random.default_rng(1).standard_normal(d), x.mean(axis=0), np.cov(x.T, bias=True).reshape(d, d)
    matrix = explain.correlated_matrix(w, cov)
    for row in x[:3]:
        assert matrix @ (row - mean) == pytest.approx(enumerated(w, mean, cov, row), abs=1e-8)


def test_features_that_follow_from_others():
    """A copy, a sum and a constant: what is known already adds nothing, and nothing is divided by zero."""
    x = correlated_rows(3)
    x = np.column_stack([x, x[:, 0], x[:, 1] + x[:, 2], np.full(len(x), 7.0)])
    w, mean, cov = np.array([1.0, -2.0, 0.5, 3.0, 1.0, 4.0]), x.mean(axis=0), np.cov(x.T, bias=True)
    matrix = explain.correlated_matrix(w, cov)
    for row in x[:3]:
        assert matrix @ (row - mean) == pytest.approx(enumerated(w, mean, cov, row), abs=1e-6)


def test_seeded_orders_come_near():
    x = correlated_rows(7, seed=3)
    w, cov = np.random.default_rng(2).standard_normal(7), np.cov(x.T, bias=True)
    exact, near = explain.correlated_matrix(w, cov), explain.correlated_matrix(w, cov, exact=0, orders=2000)
    scale = np.abs(exact).max()
    assert np.abs(exact - near).max() < 0.05 * scale
    assert near.sum(axis=0) == pytest.approx(w) and exact.sum(axis=0) == pytest.approx(w)
    assert (near == explain.correlated_matrix(w, cov, exact=0, orders=2000)).all()


def test_independent_features_give_weight_times_distance():
    w = np.array([2.0, -1.0, 0.5])
    assert explain.correlated_matrix(w, np.diag([1.0, 4.0, 9.0])) == pytest.approx(np.diag(w))


@pytest.fixture(scope="module")
def fitted(spark):
    x = correlated_rows(4, n=300, seed=9)
    y = (x[:, 0] - x[:, 2] + np.random.default_rng(3).normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "id int, label int, a double, `b.c` double, c double, d double")
    df = prep.assemble(df.withColumnRenamed("b.c", "b"), list("abcd")).repartition(4).persist()
    return x, df, LogisticRegression(maxIter=50).fit(df)


def test_mean_and_covariance(fitted):
    x, df, _ = fitted
    mean, cov = explain.mean_and_covariance(df, list("abcd"))
    assert mean == pytest.approx(x.mean(axis=0)) and cov == pytest.approx(np.cov(x.T, bias=True))


@pytest.mark.parametrize("correlated", [True, False])
def test_values_add_up(fitted, correlated):
    x, df, model = fitted
    w = model.coefficients.toArray()
    train, test = df.filter("id < 200"), df.filter("id >= 200")
    got = explain.shap_values(model, test, list("abcd"), ["id"], train, correlated)
    rows = {(r["id"], r["feature"]): r["value"] for r in got.collect()}
    assert len(rows) == 400
    mean = x[:200].mean(axis=0)
    cov = np.cov(x[:200].T, bias=True)
    for i in (200, 250, 299):
        values = [rows[i, c] for c in "abcd"]
        assert sum(values) == pytest.approx(w @ (x[i] - mean), abs=1e-8)
        want = enumerated(w, mean, cov, x[i]) if correlated else w * (x[i] - mean)
        assert values == pytest.approx(want.tolist(), abs=1e-8)
    per_feature = {r["feature"]: r["v"] for r in got.groupBy("feature").agg(F.avg(F.abs("value")).alias("v")).collect()}
    told = {r["feature"]: r["shap"] for r in explain.explain(model, train, test, list("abcd"), correlated).collect()}
    assert told == pytest.approx(per_feature)


def test_no_rows(fitted):
    _, df, model = fitted
    none = df.limit(0)
    assert explain.shap_values(model, none, list("abcd"), ["id"], df).collect() == []
    assert explain.explain(model, df, none, list("abcd")).collect() == []
