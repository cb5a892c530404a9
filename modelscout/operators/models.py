"""The catalogue of classifiers, training and scoring."""
from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.functions.columns import as_column
from modelscout.operators.boosting import HistogramBoosting
from modelscout.operators.gradient import GradientBoosting
from modelscout.operators.penalized import PenalizedLogisticRegression

LOCAL, SPARK = 0, 1
CLASSIFICATION = 0
LINEAR, TREE = 1, 2

# Fixed catalogue: id, impl_type, problem_type, algo_type, algo_name, algo_class, params.
# "C" is the inverse penalty weight of the summed loss; for MLlib it becomes regParam = 1/(C*n) of the mean loss at fit time.
CATALOGUE = [
    (0, LOCAL, CLASSIFICATION, LINEAR, "Lasso Logistic Regression", "PenalizedLogisticRegression",
     {"C": 1.0, "penalty": "l1", "maxIter": 10000}),
    (1, LOCAL, CLASSIFICATION, TREE, "Random Forest", "RandomForestClassifier",
     {"numTrees": 100, "maxDepth": 2, "seed": 0}),
    (2, LOCAL, CLASSIFICATION, TREE, "Gradient Boosting", "GBTClassifier",
     {"maxIter": 100, "maxDepth": 1, "stepSize": 1.0, "seed": 0}),
    (3, LOCAL, CLASSIFICATION, TREE, "Boosted Trees (leaf by leaf)", "HistogramBoosting",
     {"numTrees": 100, "numLeaves": 31, "stepSize": 0.1, "minRows": 20}),
    (4, LOCAL, CLASSIFICATION, LINEAR, "Logistic Regression", "LogisticRegression",
     {"C": 1.0, "elasticNetParam": 0.0, "standardization": False, "maxIter": 10000}),
    (5, LOCAL, CLASSIFICATION, LINEAR, "Ridge Logistic Regression", "PenalizedLogisticRegression",
     {"C": 1.0, "penalty": "l2", "maxIter": 10000}),
    (6, SPARK, CLASSIFICATION, LINEAR, "Lasso Logistic Regression", "LogisticRegression",
     {"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 1.0}),
    (7, SPARK, CLASSIFICATION, LINEAR, "Ridge Logistic Regression", "LogisticRegression",
     {"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 0.0}),
    (8, SPARK, CLASSIFICATION, TREE, "Random Forest", "RandomForestClassifier", {"numTrees": 10, "seed": 0}),
    (9, SPARK, CLASSIFICATION, TREE, "Gradient Boosting", "GBTClassifier", {"seed": 0}),
]
ESTIMATORS = {
    "LogisticRegression": LogisticRegression,
    "RandomForestClassifier": RandomForestClassifier,
    "GBTClassifier": GradientBoosting,  # trains MLlib's model
    "PenalizedLogisticRegression": PenalizedLogisticRegression,
    "HistogramBoosting": HistogramBoosting,
}
# Estimators of this library; all others are MLlib's.
OWN = {"PenalizedLogisticRegression": "modelscout.operators.penalized", "HistogramBoosting": "modelscout.operators.boosting"}
CATALOGUE_SCHEMA = (
    "id INT, impl_type INT, problem_type INT, algo_type INT, algo_name STRING, import_pkg STRING, algo_class STRING, "
    "params STRING"
)


def catalogue(
    spark: SparkSession, impl_type: int | None = None, problem_type: int | None = CLASSIFICATION
) -> DataFrame:
    """The catalogue as a table, ordered by id."""
    rows = [
        (id, impl, problem, kind, name, OWN.get(cls, "pyspark.ml.classification"), cls, json.dumps(params))
        for id, impl, problem, kind, name, cls, params in CATALOGUE
    ]
    df = spark.createDataFrame(rows, CATALOGUE_SCHEMA)
    if impl_type is not None:
        df = df.filter(F.col("impl_type") == impl_type)
    if problem_type is not None:
        df = df.filter(F.col("problem_type") == problem_type)
    return df.orderBy("id")


def catalogue_row(id: int) -> dict:
    row = CATALOGUE[id]
    return {"id": row[0], "impl_type": row[1], "algo_type": row[3], "algo_name": row[4], "algo_class": row[5],
            "params": json.dumps(row[6])}


def build_estimator(row: dict, label: str = "label", n_train: int | None = None, features: str = "features") -> Estimator:
    """The estimator of a catalogue row. Only the classes in ``ESTIMATORS`` can be built."""
    if row["algo_class"] not in ESTIMATORS:
        raise ValueError(f"unknown estimator {row['algo_class']!r}")
    params = json.loads(row["params"]) if row["params"] else {}
    inverse_penalty = None if row["algo_class"] in OWN else params.pop("C", None)
    if inverse_penalty is not None:
        if not n_train:
            raise ValueError("the penalty of this model depends on the number of training rows")
        params["regParam"] = 1.0 / (inverse_penalty * n_train)
    return ESTIMATORS[row["algo_class"]](featuresCol=features, labelCol=label, **params)


def fit(estimator: Estimator, train: DataFrame) -> Model:
    return estimator.fit(train)


def score(model: Model, df: DataFrame, label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., y, prediction, score): hard label and probability of class 1."""
    out = model.transform(df)
    return out.select(
        *[as_column(c) for c in keep],
        as_column(label).cast("int").alias("y"),
        F.col("prediction").cast("int").alias("prediction"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
    )
