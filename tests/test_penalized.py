"""Penalised logistic regression against its optimality conditions and a plain numpy solver."""
import numpy as np
import pytest

from modelscout.operators import explain, models, penalized, prep
from modelscout.operators.penalized import PenalizedLogisticRegression, newton_step


def rows_of(n=400, d=6, seed=0, shift=3.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.array([1, 5, 0.2, 1, 1, 30.0][:d]) + shift
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(0, 1, n) > x[:, 0].mean() - 0.3 * x[:, 1].mean()).astype(int)
    return x, y


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x)], ", ".join(["label int", *[f"{n} double" for n in names]]))
    return prep.assemble(df, names).repartition(5)


def gradient(x, y, w, c):
    x = np.column_stack([x, np.ones(len(x))])
    return c * x.T @ (1 / (1 + np.exp(-(x @ w))) - y)


def plain_l2(x, y, c):
    """Newton's method on the whole table."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), c * z.T @ (p - y) + w)
    return w


def plain_l1(x, y, c):
    """Accelerated shrinkage steps on the whole table, on its own scale."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    rate = 1 / (c * np.linalg.eigvalsh(z.T @ z)[-1] / 4)
    ahead, pace = w.copy(), 1.0
    for _ in range(200_000):
        move = ahead - rate * c * z.T @ (1 / (1 + np.exp(-(z @ ahead))) - y)
        new = np.sign(move) * np.maximum(np.abs(move) - rate, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + (pace - 1) / next_pace * (new - w)
        if (new - w) @ (ahead - new) < 0:
            next_pace, ahead = 1.0, new
        w, pace = new, next_pace
    return w


@pytest.mark.parametrize("c", [0.02, 1.0])
def test_l2(spark, c):
    x, y = rows_of()
    model = PenalizedLogisticRegression(C=c, penalty="l2").fit(frame(spark, x, y))
    w = np.append(model.coefficients, model.intercept)
    assert np.abs(gradient(x, y, w, c) + w).max() <= 1e-6 and model.violation <= 1e-6
    assert w == pytest.approx(plain_l2(x, y, c), abs=1e-6)


@pytest.mark.parametrize("c", [0.02, 1.0])
def test_l1(spark, c):
    x, y = rows_of(n=300, d=4)
    model = PenalizedLogisticRegression(C=c, penalty="l1").fit(frame(spark, x, y))
    w, g = np.append(model.coefficients, model.intercept), gradient(x, y, np.append(model.coefficients, model.intercept), c)
    for a, b in zip(w, g):
        assert abs(b + np.sign(a)) <= 1e-6 if a else abs(b) <= 1 + 1e-6
    assert w == pytest.approx(plain_l1(x, y, c), abs=1e-4)
    if c < 0.1:
        assert (w == 0).any()


def test_separable_copied_and_constant_columns(spark):
    """Without a penalty there would be no finite weights, or no single ones."""
    x = np.column_stack([np.arange(40.0), np.arange(40.0), np.full(40, 2.0), np.zeros(40)])
    y = (np.arange(40) >= 20).astype(int)
    for penalty in ("l1", "l2"):
        model = PenalizedLogisticRegression(penalty=penalty).fit(frame(spark, x, y))
        assert model.violation <= 1e-6 and np.isfinite(model.coefficients).all() and model.coefficients[3] == 0
    assert model.coefficients[0] == pytest.approx(model.coefficients[1])


def test_one_class_and_transform(spark):
    x, y = rows_of(n=50, d=2)
    df = frame(spark, x, np.ones(50, int))
    model = PenalizedLogisticRegression().fit(df)
    out = models.score(model, df).collect()
    z = x @ model.coefficients + model.intercept
    assert sorted(r["score"] for r in out) == pytest.approx(sorted(1 / (1 + np.exp(-z)))) and {r["prediction"] for r in out} == {1}
    assert PenalizedLogisticRegression().fit(df.limit(0)).coefficients.size == 0


def test_rows_of_the_catalogue(spark):
    x, y = rows_of(n=200, d=3)
    df = frame(spark, x, y)
    for id, solver in ((0, plain_l1), (5, plain_l2)):
        model = models.fit(models.build_estimator(models.catalogue_row(id), n_train=200), df)
        assert np.append(model.coefficients, model.intercept) == pytest.approx(solver(x, y, 1.0), abs=1e-3)
        shap = {r["feature"]: r["shap"] for r in explain.explain(model, df, df, ["f0", "f1", "f2"]).collect()}
        assert set(shap) == {"f0", "f1", "f2"} and min(shap.values()) >= 0


def test_step_of_a_flat_feature_is_finite():
    assert np.isfinite(newton_step(np.zeros(2), np.zeros(2), np.zeros((2, 2)), "l1")).all()


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_features_of_very_different_scales_take_few_scans(spark, monkeypatch, penalty):
    """The share of one feature's curvature that keeps the step finite must not slow down features a million times smaller."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(3000) * 100_000, rng.integers(0, 9, 3000) / 100, rng.integers(0, 2, 3000), rng.integers(1, 51, 3000)])
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] / 50_000 - 1 + 8 * (x[:, 1] - 0.04) - 0.3 * x[:, 2])))).astype(int)
    scans = []
    plain = penalized.derivatives
    monkeypatch.setattr(penalized, "derivatives", lambda *a: scans.append(1) or plain(*a))
    model = PenalizedLogisticRegression(penalty=penalty, maxIter=40).fit(frame(spark, x, y))
    assert len(scans) <= 15
    w = np.append(model.coefficients, model.intercept)
    g = gradient(x, y, w, 1.0)
    if penalty == "l2":
        assert np.abs(g + w).max() <= 1e-5
    else:
        assert all(abs(b + np.sign(a)) <= 1e-5 if a else abs(b) <= 1 + 1e-5 for a, b in zip(w, g))
