"""MLlib's boosted trees, trained on merged rows, and their explanation by cells."""
import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array

from modelscout.operators import explain, gradient, models, prep


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 4)), 2)
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 1.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 1500) > 0).astype(int)
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x)], "label int, a double, b double, c double, d double")
    return prep.assemble(df.repartition(3), list("abcd")).persist()


def chances(model, df):
    return np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])


@pytest.mark.parametrize("in_task,params", [
    (True, {"maxIter": 100, "maxDepth": 1, "stepSize": 1.0, "seed": 0}),
    (True, {"maxIter": 6, "maxDepth": 5, "minInstancesPerNode": 7, "minInfoGain": 0.01, "seed": 3}),
    (False, {"maxIter": 12, "maxDepth": 3, "seed": 0}),
])
def test_trees_are_those_of_mllib(data, monkeypatch, in_task, params):
    if not in_task:
        monkeypatch.setattr(gradient, "LOCAL_CELLS", 0)
    ours, theirs = gradient.GradientBoosting(**params).fit(data), GBTClassifier(**params).fit(data)
    assert isinstance(ours, GBTClassificationModel) and ours.treeWeights == theirs.treeWeights
    assert [(t.numNodes, t.depth) for t in ours.trees] == [(t.numNodes, t.depth) for t in theirs.trees]
    assert chances(ours, data) == pytest.approx(chances(theirs, data), abs=1e-12)
    (own, own_base), (their, their_base) = explain.tree_leaves(ours), explain.tree_leaves(theirs)
    assert own_base == pytest.approx(their_base, abs=1e-9)
    x = np.array(data.select(*"abcd").limit(200).collect())
    assert explain.tree_values(own, x) == pytest.approx(explain.tree_values(their, x), abs=1e-9)


def test_training_makes_no_job_per_tree(spark, data):
    """A hundred trees took a scan of all rows each."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "training")
    try:
        models.fit(models.build_estimator(models.catalogue_row(2)), data)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 50
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_what_merged_rows_cannot_give_is_left_to_mllib(data):
    params = {"maxIter": 3, "maxDepth": 2, "subsamplingRate": 0.5, "seed": 1}
    ours, theirs = gradient.GradientBoosting(**params).fit(data), GBTClassifier(**params).fit(data)
    assert chances(ours, data) == pytest.approx(chances(theirs, data), abs=1e-12)
    flat = prep.assemble(data.select("label", "d"), ["d"])  # a feature of one value
    assert chances(gradient.GradientBoosting(maxIter=2).fit(flat), flat) == pytest.approx(chances(GBTClassifier(maxIter=2).fit(flat), flat))


def test_one_class_only(data):
    ones = data.filter("label = 1")
    ours, theirs = gradient.GradientBoosting(maxIter=2).fit(ones), GBTClassifier(maxIter=2).fit(ones)
    assert chances(ours, ones) == pytest.approx(chances(theirs, ones))


@pytest.mark.parametrize("room", [1 << 21, 1])
def test_values_by_cells_are_those_of_the_leaves(data, monkeypatch, room):
    monkeypatch.setattr(explain, "CELL_ROOM", room)
    groups, _ = explain.leaves_by_tree(GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(data))
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    x[::50, 1] = np.nan
    leaves = [leaf for group in groups for leaf in group]
    values = explain.TreeValues(groups, 4)
    if room == 1:
        values.room = 3
    looked = []
    of = explain.tree_values
    monkeypatch.setattr(explain, "tree_values", lambda leaves, x: looked.append(len(x)) or of(leaves, x))
    for batch in (x, x[::-1], x[:0]):
        assert values(batch) == pytest.approx(of(leaves, batch), abs=1e-12)
    if room > 1:
        assert sum(looked) < 2 * len(x)  # not every row in every tree, twice


def test_no_trees_no_values():
    assert (explain.TreeValues([[]], 3)(np.ones((2, 3))) == 0).all()
