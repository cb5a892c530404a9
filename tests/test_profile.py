import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelscout.functions.columns import mean_abs, now_pacific, weighted_mean
from modelscout.sources import read_table, scratch_path, write_table
from modelscout.operators import charts, profile, quantiles, roles

NAN = float("nan")


def test_classes(make):
    df = make([], "a int, b double, c decimal(5,2), d string, e boolean, f timestamp_ntz")
    assert profile.classify(df.schema) == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2}


def test_profile_by_hand(make):
    df = make(
        [(1, 1.0, "a", True), (2, NAN, "b", None), (3, None, "b", True), (4, 4.0, None, False)],
        "i int, x double, s string, b boolean",
    )
    rows = {r["var_name"]: r for r in profile.profile(df).collect()}
    assert rows["x"]["ds_count"] == 2 and rows["x"]["ds_unique"] == 2
    assert rows["x"]["ds_mean"] == 2.5 and rows["x"]["ds_50"] == 2.5
    assert rows["i"]["ds_25"] == 1.75 and rows["i"]["ds_std"] == pytest.approx(1.2909944)
    assert rows["s"]["ds_unique"] == 2 and rows["s"]["ds_mean"] is None and rows["s"]["ds_count"] == 3
    assert rows["b"]["var_type"] == 2 and rows["b"]["ds_unique"] == 2
    assert {r["var_name"]: r["ds_unique"] for r in profile.distinct_counts(df, count_null=True).collect()} == {
        "i": 4, "x": 3, "s": 3, "b": 3,
    }
    assert {r["var_name"]: r["missing"] for r in profile.missing_counts(df).collect()} == {"i": 0, "x": 2, "s": 1, "b": 1}
    top = {r["var_name"]: (r["top"], r["freq"]) for r in profile.top_value(df).collect()}
    assert top == {"s": ("b", 2), "b": ("true", 2)}


def test_profile_of_empty_table(make):
    rows = profile.profile(make([], "x double, s string")).collect()
    assert [(r["ds_count"], r["ds_unique"], r["ds_mean"], r["ds_50"]) for r in rows] == [(0, 0, None, None)] * 2


def test_sketch_profile_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 1000).cast("double").alias("x"))
    row = profile.profile(df, exact=False).first()
    assert abs(row["ds_50"] - 500) < 5 and abs(row["ds_unique"] - 1000) < 200


@pytest.mark.parametrize("bins", [16, 1024])
def test_large_table_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(3)
    cols = {
        "normal": rng.normal(0, 100, 5001),
        "hot": np.where(rng.random(5001) < 0.4, 7.0, rng.normal(7, 1, 5001)),
        "few": rng.integers(0, 5, 5001).astype(float),
        "tail": np.exp(rng.normal(0, 60, 5001)) * rng.choice([-1, 1], 5001),
        "gaps": np.where(rng.random(5001) < 0.5, np.nan, rng.exponential(1, 5001)),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())], ", ".join(f"{c} double" for c in cols))
    found = quantiles.exact_quantiles(df, list(cols), (0.01, 0.25, 0.5, 0.75, 1.0), bins=bins)
    for c, v in cols.items():
        assert np.allclose(found[c], np.nanquantile(v, (0.01, 0.25, 0.5, 0.75, 1.0)), rtol=1e-9), c


def test_quantiles_of_extreme_values(make):
    inf = math.inf
    cases = {
        "plain": [1.0, 2.0, 2.0, 9.0, 50.0],
        "infinite": [1.0, 2.0, inf, inf, 3.0, -inf, 4.0],
        "all infinite": [inf, inf, -inf, inf],
        "wide": [-1.7e308, 1.7e308, 0.0, 1e300, -1e300, 5.0],
        "denormal": [5e-324 * k for k in range(9)] + [1e-300],
        "long tail": [float(k) for k in range(50)] + [1e12, 1e18, 1e300],
        "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0],
        "constant": [7.0] * 5,
    }
    for name, values in cases.items():
        for bins in (2, 1024):
            df = make([(v,) for v in values] + [(None,), (math.nan,)], "x double")
            got = quantiles.exact_quantiles(df, ["x"], bins=bins)["x"]
            order = sorted(values)
            for p, g in zip((0.25, 0.5, 0.75), got):
                rank = p * (len(order) - 1)
                low, high = order[math.floor(rank)], order[math.ceil(rank)]
                if low == -inf and high == inf and rank != int(rank):
                    assert math.isnan(g)  # nothing lies between opposite infinities
                    continue
                assert low <= g <= high, (name, bins, p, g)
                if rank == int(rank) or low == high:
                    assert g == low, (name, bins, p)
    row = profile.profile(make([(v,) for v in cases["infinite"]], "x double")).first()
    assert (row["ds_25"], row["ds_50"], row["ds_75"]) == (1.5, 3.0, inf)
    empty = make([(1.0,)], "x double").filter("x > 100")
    assert quantiles.exact_quantiles(empty, ["x"]) == {"x": [None, None, None]}


def test_quartiles_of_many_columns_take_one_scan_a_round(spark, monkeypatch):
    rng = np.random.default_rng(8)
    columns = {f"c{i}": (rng.normal(i, 1 + i, 300) if i % 3 else rng.integers(0, 9, 300).astype(float)) for i in range(200)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    path = write_table(df, scratch_path(spark, "wide"))
    rounds = []
    count = quantiles._bin_counts

    def counted(*args):
        rounds.append(count(*args))
        return rounds[-1]

    monkeypatch.setattr(quantiles, "_bin_counts", counted)
    found = quantiles.exact_quantiles(read_table(spark, path), list(columns), bins=32)
    for c, v in columns.items():
        assert found[c] == pytest.approx(np.quantile(v, (0.25, 0.5, 0.75)).tolist()), c
    assert 1 < len(rounds) < 8
    for r in rounds:
        assert r._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    left_out = profile.profile(df.select("c0", "c1"), quartiles=False).collect()
    assert all(r["ds_50"] is None and r["ds_mean"] is not None for r in left_out)


def test_distinct_texts_of_any_length(make):
    rows = [("a",), ("a",), ("b" * 1000,), ("b" * 1000,), ("b" * 999,), ("",), (None,)]
    df = make(rows, "t string")
    assert profile.distinct_counts(df).first()["ds_unique"] == 4
    assert profile.distinct_counts(df, count_null=True).first()["ds_unique"] == 5


def test_histogram_edges(make):
    df = make([(0.0,), (1.0,), (9.999,), (10.0,), (None,), (NAN,)], "x double")
    got = {r["bin"]: r["n"] for r in charts.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 4: 2}
    flat = charts.histogram(make([(3.0,), (3.0,)], "x double"), "x").collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(0, 2)]


def test_box(make):
    row = charts.box_stats(make([(float(v),) for v in (1, 2, 3, 4, 100)], "x double"), "x").first()
    assert (row["q1"], row["median"], row["q3"], row["upper_fence"], row["outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)


def test_samples(spark):
    df = spark.range(10000)
    a = {r[0] for r in charts.sample_about(df, 1000, key=["id"]).collect()}
    b = {r[0] for r in charts.sample_about(df.repartition(13), 1000, key=["id"]).collect()}
    assert a == b and 800 < len(a) < 1200
    assert 800 < charts.sample_about(df, 1000, rows=10000).count() < 1200
    assert charts.sample_about(df, 20000).count() == 10000
    assert charts.preview(df, 3, [F.desc("id")]).collect()[0][0] == 9999
    assert charts.preview(df).count() == 10


def test_rules(make):
    summary = make(
        [(0, "t", 1, 8, 2), (1, "name", 2, 10, 6), (2, "half", 2, 10, 5), (3, "n", 1, 10, 9)],
        "var_id int, var_name string, var_type int, ds_count bigint, ds_unique bigint",
    )
    notes = {r["var_name"]: r["quality"] for r in roles.quality_report(summary, 10, outliers=["n", "t", "name"]).collect()}
    assert notes == {"t": "missing values(2)", "name": "too many unique", "half": "", "n": "might be outliers"}
    picked = {r["var_name"]: tuple(r)[2:] for r in roles.suggest_roles(summary).collect()}
    assert picked == {"t": (1, 0, 0), "name": (0, 1, 1), "half": (0, 1, 0), "n": (0, 0, 0)}


def test_aggregate_columns(make):
    df = make([(1.0, 1.0), (4.0, 2.0), (None, 5.0), (-3.0, 0.0)], "x double, w double")
    row = df.agg(weighted_mean("x", "w").alias("w"), mean_abs("x").alias("a")).first()
    assert (row["w"], row["a"]) == (3.0, pytest.approx(8 / 3))


def test_clock_is_pacific(spark):
    row = spark.range(1).select(now_pacific().alias("p"), F.current_timestamp().cast("timestamp_ntz").alias("u")).first()
    assert (row["u"] - row["p"]).total_seconds() in (7 * 3600, 8 * 3600)
