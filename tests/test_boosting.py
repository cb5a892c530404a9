"""Boosting on histograms against a brute-force version that looks at every row for every split."""
import math

import numpy as np
import pytest

from modelscout.operators import boosting as B, explain, models, prep


def rows_of(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), np.round(rng.normal(size=n), 1), rng.integers(0, 2, n), np.full(n, 3.0)])
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 0) | (rng.random(n) < 0.1)).astype(int)
    return x.astype(float), y


def frame(spark, x, y):
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x)], "label int, a double, b double, c double, d double")
    return prep.assemble(df, list("abcd")).repartition(4)


def brute(x, y, cuts, trees, leaves, rate, min_rows, min_hessian=1e-3):
    """[(rows, value, feature, cut) of every node] of each tree, and the scores; every split is looked for among all rows of a leaf."""
    raw = np.full(len(x), math.log(y.mean() / (1 - y.mean())))
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = rows & (x[:, f] <= c)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) < min_rows or min(h[left].sum(), h[right].sum()) < min_hessian:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-10):
                        found = gain, f, c, left, right
            return found

        every = np.ones(len(x), dtype=bool)
        open_, done = [(every, best(every))], []
        while len(open_) < leaves and any(b for _, b in open_):
            k = max((k for k, (_, b) in enumerate(open_) if b), key=lambda k: open_[k][1][0])
            rows, (_, f, c, left, right) = open_.pop(k)
            done.append((rows.sum(), f, c))
            open_ += [(left, best(left)), (right, best(right))]
        for rows, _ in open_:
            raw[rows] -= rate * g[rows].sum() / h[rows].sum()
        out.append((sorted(done), len(open_)))
    return out, raw


@pytest.mark.parametrize("leaves,min_rows,local", [(2, 1, 0), (6, 5, 0), (6, 5, 150), (31, 20, 100), (31, 20, 1000)])
def test_splits_and_scores_equal_brute_force(spark, leaves, min_rows, local):
    x, y = rows_of()
    df = frame(spark, x, y)
    tool = B.HistogramBoosting(numTrees=3, numLeaves=leaves, stepSize=0.3, minRows=min_rows, localRows=local)
    model = tool.fit(df)
    cuts = [np.unique(x[:, i])[:-1] for i in range(4)]  # few enough values that every one is a bin
    want, raw = brute(x, y, cuts, 3, leaves, 0.3, min_rows)
    for tree, (splits, n) in zip(model.trees, want):
        assert np.array(sorted((k.rows, k.feature, k.cut) for k in tree.nodes if k.left >= 0)) == pytest.approx(np.array(splits))
        assert sum(k.left < 0 for k in tree.nodes) == n
    assert model.raw(x) == pytest.approx(raw, abs=1e-9)
    got = sorted(r["score"] for r in models.score(model, df).collect())
    assert got == pytest.approx(sorted(1 / (1 + np.exp(-raw))), abs=1e-9)


def test_bins_are_quantiles_of_many_values(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=3000), rng.pareto(1, 3000), rng.integers(0, 3, 3000), np.zeros(3000)])
    df = frame(spark, x, np.zeros(3000)).selectExpr("array(a, b, c, d) AS x")
    bounds = B.bin_bounds(df, 4, 16)
    for i in (0, 1):
        inside = np.bincount(np.searchsorted(bounds[i], x[:, i], side="left"), minlength=16)
        assert len(bounds[i]) == 15 and abs(inside - 3000 / 16).max() < 30
    assert bounds[2].tolist() == [0, 1] and bounds[3].tolist() == [0]


def test_explanation_adds_up(spark):
    x, y = rows_of(300, seed=4)
    df = frame(spark, x, y).selectExpr("*", "row_number() OVER (ORDER BY a, b, c, d, label) AS id").persist()
    model = B.HistogramBoosting(numTrees=5, numLeaves=8).fit(df)
    leaves, base = explain.tree_leaves(model)
    rows = df.select("id", *"abcd").collect()
    z = np.array([list(r)[1:] for r in rows])
    assert base == pytest.approx(model.raw(z).mean())
    got = {}
    for r in explain.shap_values(model, df, list("abcd"), ["id"]).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["value"]
    assert [got[r["id"]] for r in rows] == pytest.approx((model.raw(z) - base).tolist(), abs=1e-9)


def test_catalogue_row_and_one_class(spark):
    x, y = rows_of(600)
    tool = models.build_estimator(models.catalogue_row(3), n_train=600)
    assert (tool.n_trees, tool.n_leaves, tool.rate, tool.min_rows) == (100, 31, 0.1, 20)
    tool.n_trees = 12
    df = frame(spark, x, y)
    hits = models.score(models.fit(tool, df), df).selectExpr("avg(int(y = prediction)) AS a").first()["a"]
    assert hits > 0.8
    one = B.HistogramBoosting(numTrees=3).fit(frame(spark, x, np.ones(600)))
    assert not one.trees and {r["prediction"] for r in models.score(one, df).collect()} == {1}
    assert B.HistogramBoosting().fit(df.limit(0)).trees == []
    with pytest.raises(ValueError):
        B.HistogramBoosting(maxBins=300)


def test_deep_paths_are_explained_in_seconds():
    """A path over twelve features, against the sum over all coalitions; one over forty ends as fast."""
    import time
    from itertools import combinations

    rng = np.random.default_rng(6)
    for m in (1, 2, 5, 12):
        leaf = explain.Leaf(2.5, {f: (-math.inf, 0.0, float(c)) for f, c in enumerate(rng.uniform(0.05, 0.95, m))})
        x = rng.normal(size=(3, m))
        met = (x <= 0).astype(float)
        want = np.zeros((3, m))
        for i in range(min(m, 4)):
            rest = [j for j in range(m) if j != i]
            for size in range(m):
                share = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                for inside in combinations(rest, size):
                    factors = np.where(np.isin(rest, inside), met[:, rest], leaf.cover[rest])
                    want[:, i] += share * 2.5 * factors.prod(axis=1) * (met[:, i] - leaf.cover[i])
        assert leaf.values(x)[:, :4] == pytest.approx(want[:, :4], abs=1e-12)
        assert leaf.values(x).sum(axis=1) == pytest.approx(2.5 * (met.prod(axis=1) - leaf.cover.prod()), abs=1e-12)
    start = time.perf_counter()
    leaf = explain.Leaf(1.0, {f: (-math.inf, 0.0, 0.9) for f in range(40)})
    values = leaf.values(rng.normal(size=(20_000, 40)))
    assert np.isfinite(values).all() and time.perf_counter() - start < 10


def test_equal_rows_take_part_once_and_count_as_many(spark):
    x, y = rows_of(60)
    x, y = np.tile(x, (40, 1)), np.tile(y, 40)
    tool = B.HistogramBoosting(numTrees=2, numLeaves=6, stepSize=0.3, minRows=5)
    model = tool.fit(frame(spark, x, y))
    trees, raw = brute(x, y, [np.unique(c)[:-1] for c in x.T], 2, 6, 0.3, 5)
    assert model.raw(x) == pytest.approx(raw)
    assert [t.nodes[0].rows for t in model.trees] == [2400, 2400]
    bins = B.bin_bounds(frame(spark, x, y).selectExpr("array(a, b, c, d) AS x"), 4, 255)
    kept = B._written(B._blocks(B._binned(frame(spark, x, y).selectExpr("array(a, b, c, d) AS x", "double(label) AS y"), bins), 0.0))
    assert kept.map(lambda block: len(block[1])).sum() == len(np.unique(np.column_stack([x, y]), axis=0))
    assert kept.map(lambda block: float(block[2].sum())).sum() == 2400


def test_histograms_of_many_tasks_are_added_up_by_tasks(spark, monkeypatch):
    x, y = rows_of()
    rows = frame(spark, x, y).selectExpr("array(a, b, c, d) AS x", "double(label) AS y")
    bins = B.bin_bounds(rows, 4, 255)
    state = B._written(B._blocks(B._binned(rows, bins), 0.1)).repartition(9)
    plain = B.histograms(state, B.Tree(), [0], 4, 255)
    monkeypatch.setattr(B, "PARTS_AT_ONCE", 2)
    assert B.histograms(state, B.Tree(), [0], 4, 255) == pytest.approx(plain) and plain[0, 0, :, 2].sum() == 400


@pytest.mark.parametrize("seed", [3, 4])
def test_large_leaves_met_after_small_ones_were_grown(spark, seed):
    """Leaves that are counted and leaves below one that was grown to its end are open at a time."""
    rng = np.random.default_rng(seed)
    n, cuts = 1500, [np.arange(99.0)] * 3 + [np.zeros(1)]
    x = np.column_stack([rng.integers(0, 100, (n, 3)), np.zeros(n, int)]).astype(np.uint8)
    y = (rng.random(n) < np.where(x[:, 0] < 10, x[:, 1] > 50, 0.3 + 0.4 * (x[:, 2] > 70))).astype(float)
    state = spark.sparkContext.parallelize([(x[i::3], y[i::3], np.ones(500), np.zeros(500)) for i in range(3)], 3)
    plain, mixed = (B.HistogramBoosting(numLeaves=31, minRows=5, localRows=local)._grow(state, cuts, n) for local in (0, 400))
    shape = lambda tree: [(m.rows, m.feature, m.bin, m.left) for m in tree.nodes]
    assert shape(plain) == shape(mixed)
