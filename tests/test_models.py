import json
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from modelscout.operators import explain, metrics, models, prep, ranking
from modelscout.plans import experiments, importing
from modelscout.sources import ResultStore, scratch_path, write_table


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 600) > 0).astype(int)
    rows = [(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double, c double, d double")
    return prep.assemble(df, list("abcd")).persist()


def scored(make):
    return make(
        [(1, 1, 0.9), (1, 1, 0.8), (0, 1, 0.8), (1, 0, 0.3), (0, 0, 0.3), (0, 0, 0.1), (0, 0, 0.0)],
        "y int, p int, s double",
    )


def test_metrics_against_evaluators(make):
    df = scored(make)
    assert tuple(metrics.confusion(df, "y", "p").first()) == (2, 1, 3, 1)
    row = metrics.all_metrics(df, "y", "p").first()
    d = df.select(F.col("y").cast("double").alias("label"), F.col("p").cast("double").alias("prediction"), "s")
    multi = MulticlassClassificationEvaluator()
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall")):
        assert row[ours] == pytest.approx(multi.evaluate(d, {multi.metricName: theirs}))
    hard = BinaryClassificationEvaluator(rawPredictionCol="prediction", numBins=0).evaluate(d)
    assert row["auc_hard"] == pytest.approx(hard)
    assert metrics.auc(df, "y", "p").first()[0] == pytest.approx(hard)
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx(
        BinaryClassificationEvaluator(rawPredictionCol="s", numBins=0).evaluate(d)
    )


def test_metric_corners(make):
    none = make([(1, 0, 0.5), (0, 0, 0.5)], "y int, p int, s double")
    row = metrics.binary_metrics(none, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.5, 0.0, 0.0)
    assert metrics.auc(none, "y", "s").first()[0] == 0.5
    assert metrics.auc(none.filter("y = 1"), "y", "s").first()[0] is None
    assert metrics.auc(none.limit(0), "y", "s").first()[0] is None


def test_auc_survives_monotone_change_and_many_scores(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.normal(size=5000), 3)
    y = (rng.random(5000) < 1 / (1 + np.exp(-s))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    exact = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx(exact, abs=1e-12)
    assert metrics.auc(df.withColumn("s", F.exp("s") * 1000), "y", "s").first()[0] == pytest.approx(exact, abs=1e-12)


def test_catalogue(spark):
    assert [r["id"] for r in models.catalogue(spark).collect()] == list(range(10))
    assert [r["id"] for r in models.catalogue(spark, models.SPARK).collect()] == [6, 7, 8, 9]
    assert models.catalogue(spark, problem_type=1).count() == 0
    plain = models.build_estimator(models.catalogue_row(4), n_train=200)
    assert plain.getRegParam() == 1 / 200 and plain.getElasticNetParam() == 0.0
    with pytest.raises(ValueError):
        models.build_estimator(models.catalogue_row(4))
    lasso, ridge = (models.build_estimator(models.catalogue_row(i)) for i in (0, 5))
    assert (lasso.penalty, lasso.C, ridge.penalty, ridge.C) == ("l1", 1.0, "l2", 1.0)
    with pytest.raises(ValueError):
        models.build_estimator({"algo_class": "Popen", "params": None})


@pytest.mark.parametrize("id,direct", [
    (6, lambda: LogisticRegression(maxIter=1000, regParam=0.01, elasticNetParam=1.0)),
    (7, lambda: LogisticRegression(maxIter=1000, regParam=0.01, elasticNetParam=0.0)),
    (8, lambda: RandomForestClassifier(numTrees=10, seed=0)),
    (9, lambda: GBTClassifier(seed=0)),
])
def test_rows_equal_direct_calls(data, id, direct):
    ours = models.score(models.fit(models.build_estimator(models.catalogue_row(id)), data), data, keep=("id",))
    theirs = direct().fit(data).transform(data)
    a = [r["prediction"] for r in ours.orderBy("id").collect()]
    b = [int(r["prediction"]) for r in theirs.orderBy("id").collect()]
    assert a == b


def subset_value(tree_nodes, x, known, features):
    """Expected output of a tree when only ``known`` features are given, by the row counts of its nodes."""
    def walk(at):
        node = tree_nodes[at]
        if node["leftChild"] < 0:
            return features(node)
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        l, r = node["leftChild"], node["rightChild"]
        if f in known:
            return walk(l if x[f] <= cut else r)
        a, b = tree_nodes[l]["rawCount"], tree_nodes[r]["rawCount"]
        return (a * walk(l) + b * walk(r)) / (a + b)
    return walk(0)


@pytest.mark.parametrize("estimator", [lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1)])
def test_tree_values_are_shapley_values(spark, data, estimator):
    estimator = estimator()
    model = estimator.fit(data)
    path = scratch_path(spark, "m")
    model.write().save(path)
    nodes = {}
    for r in spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    boosted = isinstance(estimator, GBTClassifier)
    value = (lambda n: n["prediction"]) if boosted else (lambda n: n["impurityStats"][1] / sum(n["impurityStats"]))
    weights = [2 * w for w in model.treeWeights] if boosted else [1 / 4] * 4

    def game(x, known):
        return sum(weights[t] * subset_value(n, x, known, value) for t, n in nodes.items())

    rows = data.orderBy("id").limit(12)
    got = {}
    for r in explain.shap_values(model, rows, list("abcd"), ["id"]).collect():
        got[r["id"], r["feature"]] = r["value"]
    out = model.transform(rows).orderBy("id").collect()
    _, base = explain.tree_leaves(model)
    for r in out:
        x = [r[c] for c in "abcd"]
        for f in range(4):
            rest = [j for j in range(4) if j != f]
            phi = sum(
                factorial(k) * factorial(3 - k) / factorial(4) * (game(x, {*s, f}) - game(x, set(s)))
                for k in range(4) for s in combinations(rest, k)
            )
            assert got[r["id"], "abcd"[f]] == pytest.approx(phi, abs=1e-10)
        raw = 2 * r["rawPrediction"][1] if boosted else r["probability"][1]
        assert base + sum(got[r["id"], c] for c in "abcd") == pytest.approx(raw, abs=1e-9)
    mean = {r["feature"]: r["shap"] for r in explain.tree_shap(model, rows, list("abcd")).collect()}
    for c in "abcd":
        assert mean[c] == pytest.approx(np.mean([abs(got[i, f]) for i, f in got if f == c]))


def test_linear_explanation(make):
    train = make([(1.0, 0.0), (3.0, 10.0)], "a double, `b.c` double")
    test = make([(2.0, 5.0), (5.0, 6.0)], "a double, `b.c` double")
    got = {r["feature"]: r["shap"] for r in explain.linear_shap({"a": -2.0, "b.c": 1.0}, train, test).collect()}
    assert got == {"a": 3.0, "b.c": 0.5}


def test_best_per_group_breaks_ties(make):
    df = make([(1, 2, 0.9), (1, 1, 0.9), (2, 5, 0.1), (2, 6, None)], "g int, a int, auc double")
    got = ranking.best_per_group(df, "g", [F.desc("auc"), F.asc("a")]).collect()
    assert {(r["g"], r["a"]) for r in got} == {(1, 1), (2, 5)}


@pytest.mark.parametrize("separable", [True, False])
def test_experiment_end_to_end(spark, separable):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        survived = int(x > 0) if separable else int(rng.random() < 0.5)
        rows.append((i, survived, "mf"[i % 2], x if i % 9 else None, float(rng.normal()) if i % 11 else None))
    if separable:
        rows = [(i, s, k, x if x is not None else (1.0 if s else -1.0), z) for i, s, k, x, z in rows]
    df = spark.createDataFrame(rows, "pid int, survived int, sex string, x double, z double")
    src = write_table(df, scratch_path(spark, "src"), "csv")
    store = ResultStore(spark, scratch_path(spark, "store"))
    id = importing.import_dataset(spark, src, "people", store)
    run = experiments.run_experiment(store, "first", id, "survived", ["sex"], ["pid"], keys=["pid"])
    assert isinstance(run, int)
    table = experiments.experiment_table(store, run).collect()
    assert len(table) == 4 and [r["auc"] for r in table] == sorted((r["auc"] for r in table), reverse=True)
    if separable:
        assert table[0]["auc"] > 0.99
    else:
        assert all(0.3 < r["auc"] < 0.7 for r in table)
    best = experiments.best_models(store, id).collect()
    assert len(best) == 1 and best[0]["best_auc"] == table[0]["auc"] and best[0]["features"] == "sex, x, z"
    ranks = experiments.shap_ranking(store, table[0]["id"]).collect()
    assert {r["feature"] for r in ranks} == {"x", "z", "sex_m"}
    assert [r["shap"] for r in ranks] == sorted((r["shap"] for r in ranks), reverse=True)
    if separable:
        assert ranks[0]["feature"] == "x"
    stored = store.read("experiment_detail", experiment_id=run).collect()
    assert all(json.loads(r["shap"]) and abs(r["weighted_recall"] - r["accuracy"]) < 1e-12 for r in stored)
    with pytest.raises(KeyError):
        experiments.experiment_table(store, run + 1)


def test_failed_rows_are_taken_up_again(spark, monkeypatch):
    """What the other rows gave stays; with the run's id only the missing ones are trained."""
    rng = np.random.default_rng(4)
    rows = [(i, int(x + rng.normal() > 0), float(x)) for i, x in enumerate(rng.normal(size=200))]
    store = ResultStore(spark, scratch_path(spark, "store"))
    src = write_table(spark.createDataFrame(rows, "pid int, y int, x double"), scratch_path(spark, "src"))
    id = importing.import_dataset(spark, src, "rows", store, fmt="parquet")
    fit, trained = models.fit, []

    def sometimes(estimator, train):
        trained.append(type(estimator).__name__)
        if broken and isinstance(estimator, RandomForestClassifier):
            raise RuntimeError("no forest today")
        return fit(estimator, train)

    monkeypatch.setattr(models, "fit", sometimes)
    broken = True
    with pytest.raises(experiments.ExperimentFailed, match="no forest today") as caught:
        experiments.run_experiment(store, "runs", id, "y", (), ["pid"], keys=["pid"])
    run = caught.value.run
    assert set(caught.value.failed) == {8} and store.read("experiment").count() == 0
    first = {r["algo_id"]: r["id"] for r in store.read_all("experiment_detail", experiment_id=run).collect()}
    assert set(first) == {6, 7, 9}
    broken, trained[:] = False, []
    assert experiments.run_experiment(store, "runs", id, "y", (), ["pid"], keys=["pid"], run=run) == run
    assert trained == ["RandomForestClassifier"]
    stored = {r["algo_id"]: r["id"] for r in store.read("experiment_detail", experiment_id=run).collect()}
    assert set(stored) == {6, 7, 8, 9} and first.items() <= stored.items() and len(set(stored.values())) == 4
    assert store.read("experiment").count() == 1
