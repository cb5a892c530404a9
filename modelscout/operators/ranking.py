"""Rankings over result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SHAP_MAP = "map<string,double>"


def best_per_group(df: DataFrame, by: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group under a total order. Spark prunes to one row per group before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def leaderboard_rows(experiment: DataFrame, detail: DataFrame, algo: DataFrame) -> DataFrame:
    """Run x detail x algorithm. The catalogue is a fixed list of a few rows, so it is broadcast."""
    runs = experiment.select(
        F.col("id").alias("experiment_id"), "experiment_name", "target_name", "features", "dataset_id"
    )
    names = algo.select(F.col("id").alias("algo_id"), "algo_name", "params")
    return detail.join(F.broadcast(names), "algo_id").join(runs, "experiment_id")


def best_models(experiment: DataFrame, detail: DataFrame, algo: DataFrame) -> DataFrame:
    """Best model per run by AUC; equal AUCs go to the lower algorithm id, then the lower detail id."""
    best = best_per_group(detail, "experiment_id", [F.desc("auc"), F.asc("algo_id"), F.asc("id")])
    return leaderboard_rows(experiment, best, algo).select(
        F.col("experiment_id").alias("id"),
        F.col("experiment_name").alias("name"),
        F.col("target_name").alias("target"),
        "features",
        F.col("algo_name").alias("best_model"),
        F.col("auc").alias("best_auc"),
        "precision",
        "recall",
        "accuracy",
    )


def experiment_table(detail: DataFrame, algo: DataFrame, experiment_id: int | None = None) -> DataFrame:
    """All models of one run (or of all runs) with name and parameters, best first."""
    if experiment_id is not None:
        detail = detail.filter(F.col("experiment_id") == experiment_id)
    names = algo.select(F.col("id").alias("algo_id"), F.col("algo_name").alias("model"), F.col("params").alias("parameters"))
    return (
        detail.join(F.broadcast(names), "algo_id")
        .select("experiment_id", "id", "model", "parameters", "auc", "precision", "recall", "accuracy")
        .orderBy("experiment_id", F.desc("auc"), "id")
    )


def shap_to_json(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """(by, feature, shap) rows to one JSON object per group. Features per model are few by nature."""
    by = [by] if isinstance(by, str) else list(by)
    entries = F.array_sort(F.collect_list(F.struct("feature", "shap")))
    return df.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("shap"))


def shap_ranking(detail: DataFrame, id: int | None = None) -> DataFrame:
    """Stored explanation of one model (or of all), one row per feature, largest first."""
    if id is not None:
        detail = detail.filter(F.col("id") == id)
    rows = detail.select("id", F.explode(F.from_json("shap", SHAP_MAP)).alias("feature", "shap"))
    return rows.orderBy("id", F.desc("shap"), "feature")
