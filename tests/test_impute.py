import numpy as np
import pandas as pd
import pytest

from modelscout.operators.impute import Boxes, KnnImpute, bounded_distances, box_bounds


def brute(donors, rows, k):
    d, out, means = donors.shape[1], rows.copy(), np.nanmean(donors, axis=0)
    for i, r in enumerate(rows):
        diff = donors - r
        ok = ~np.isnan(diff)
        total = np.where(ok, diff**2, 0).sum(axis=1)
        shared = ok.sum(axis=1)
        for c in np.flatnonzero(np.isnan(r)):
            near = sorted(
                (d / s * t, v) for s, t, v in zip(shared, total, donors[:, c]) if s and not np.isnan(v)
            )[:k]
            out[i, c] = np.mean([v for _, v in near]) if near else means[c]
    return out


def frame(make, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return make(rows, "id int, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


def gappy(rng, n, d, gap, digits):
    x = np.round(rng.normal(0, 10, (n, d)), digits)
    x[rng.random((n, d)) < gap] = np.nan
    return x


@pytest.mark.parametrize(
    "n,d,gap,digits,leaf,patterns,k",
    [
        (300, 2, 0.3, 1, 8, 64, 2),
        (300, 3, 0.3, 0, 8, 64, 2),
        (300, 4, 0.15, 2, 16, 3, 2),
        (150, 3, 0.6, 0, 4, 1, 2),
        (40, 3, 0.5, 0, 512, 64, 3),
        (400, 6, 0.2, 0, 16, 64, 2),
        (400, 10, 0.15, 1, 16, 64, 2),
        (300, 10, 0.6, 0, 8, 2, 3),
        (300, 20, 0.1, 1, 16, 64, 2),
    ],
)
def test_equals_all_pairs(make, n, d, gap, digits, leaf, patterns, k):
    rng = np.random.default_rng(n + d)
    donors, rows = gappy(rng, n, d, gap, digits), gappy(rng, 80, d, gap, digits)
    model = KnnImpute([f"c{j}" for j in range(d)], k=k, leaf_rows=leaf, max_patterns=patterns).fit(frame(make, donors))
    got = model.transform(frame(make, rows)).orderBy("id").toPandas().to_numpy(dtype=float)[:, 1:]
    assert np.allclose(got, brute(donors, rows, k), rtol=1e-12)


def clustered(rng, centres, n, gap):
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 1, (n, centres.shape[1]))
    x[rng.random(x.shape) < gap] = np.nan
    return x


def test_most_pairs_of_a_wide_table_are_skipped(make):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (12, 10))
    donors, rows = clustered(rng, centres, 1500, 0.1), clustered(rng, centres, 150, 0.2)
    model = KnnImpute([f"c{j}" for j in range(10)], leaf_rows=64).fit(frame(make, donors))
    df = frame(make, rows)
    got = model.transform(df).orderBy("id").toPandas().to_numpy(dtype=float)[:, 1:]
    assert np.allclose(got, brute(donors, rows, 2), rtol=1e-12)
    effort = model.search_effort(df).first()
    assert 0 < effort["computed"] < 0.5 * effort["pairs"]


@pytest.mark.parametrize("gap", [0.0, 0.2, 0.6])
def test_bounds_never_exclude_a_pair(gap):
    rng = np.random.default_rng(int(gap * 10))
    donors, rows = gappy(rng, 200, 7, gap, 1), gappy(rng, 50, 7, 0.3, 1)
    exact, _ = bounded_distances(rows, np.full(50, np.inf), donors)
    limit = np.sort(exact, axis=1)[:, 4]
    got, begun = bounded_distances(rows, limit, donors)
    inside = exact <= limit[:, None]
    assert begun <= exact.size and (got[inside] == exact[inside]).all() and np.isinf(got[~inside]).all()
    known = ~np.isnan(donors)
    stats = pd.DataFrame({
        "_leaf": [0], "g": [0], "rows": [200], "lo": [np.nanmin(donors, axis=0)], "hi": [np.nanmax(donors, axis=0)],
        "gaps": [(~known).sum(axis=0)], "have": [known.sum(axis=0)],
    })
    for row, mine in zip(rows, exact):
        if not np.isnan(row).all():
            near, far = box_bounds(row[None], ~np.isnan(row), Boxes(stats, 1), np.array([0]))
            mine = mine[np.isfinite(mine)]
            assert near[0, 0] <= mine.min() * (1 + 1e-12) and far[0, 0] >= mine.max() * (1 - 1e-12)


def test_one_column_takes_the_train_mean(make):
    model = KnnImpute(["x"]).fit(make([(1.0,), (3.0,), (None,)], "x double"))
    assert sorted(r[0] for r in model.transform(make([(None,), (9.0,)], "x double")).collect()) == [2.0, 9.0]


def test_hot_values_and_other_columns_survive(make):
    rows = [(i, 5.0, 1.0, "s") for i in range(500)] + [(500 + i, 5.0, None, "t") for i in range(500)] + [(1000, 7.0, 3.0, "u")]
    df = make(rows, "id int, a double, b double, s string")
    got = KnnImpute(["a", "b"]).fit(df).transform(df)
    assert got.count() == 1001 and got.filter("b is null").count() == 0
    assert {(r["b"], r["s"]) for r in got.select("b", "s").distinct().collect()} == {(1.0, "s"), (1.0, "t"), (3.0, "u")}


def test_nothing_to_compare_with(make):
    df = make([(1.0, 2.0), (None, None), (3.0, 4.0)], "a double, b double")
    got = KnnImpute(["a", "b"]).fit(df).transform(df)
    assert {tuple(r) for r in got.collect()} == {(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)}
