"""Runs: train the catalogue on one dataset, score, explain, keep the results."""
from __future__ import annotations

import json
from collections.abc import Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from modelscout.operators import models
from modelscout.operators.explain import explain
from modelscout.operators.metrics import all_metrics, auc
from modelscout.operators.ranking import best_models as best_models_of, experiment_table as table_of, shap_ranking as ranking_of
from modelscout.plans.importing import read_dataset
from modelscout.plans.preparing import Prepared, prepare, vectors
from modelscout.sources.store import ResultStore

WORKERS = 4  # rows of the catalogue that are trained side by side


def evaluate(model, test: DataFrame, label: str) -> dict[str, float]:
    """Every metric of one model. The scored rows are kept while AUC and the label metrics read them."""
    scored = models.score(model, test, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = all_metrics(scored, "y", "prediction").first().asDict()
        out["auc"] = auc(scored, "y", "score").first()[0]
    finally:
        scored.unpersist()
    return out


class ExperimentFailed(RuntimeError):
    """Some rows of the catalogue could not be trained. What the others gave is stored under the run's id, by which it is taken up."""

    def __init__(self, run: int, failed: dict[int, Exception]):
        super().__init__(f"run {run}: rows {sorted(failed)} of the catalogue failed: " + "; ".join(f"{k}: {e}" for k, e in failed.items()))
        self.run, self.failed = run, failed


def run_models(
    p: Prepared, impl_type: int, partitions: int | None = None, workers: int = WORKERS, done: Collection[int] = ()
) -> tuple[list[dict], dict[int, Exception]]:
    """Fit, score and explain every catalogue row of one kind that is not ``done``, ``workers`` of them side by side.

    All read one train and one test table that are kept meanwhile, each in a scheduler pool of its own, so that with the fair
    scheduler none waits for another's last tasks. Returns the results in the order of the catalogue, and what failed by id.
    """
    train, test = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in vectors(p, partitions))
    context = train.sparkSession.sparkContext
    rows = [models.catalogue_row(entry[0]) for entry in models.CATALOGUE]
    rows = [row for row in rows if row["impl_type"] == impl_type and row["id"] not in done]
    results, failed = [], {}
    try:
        n = train.count()

        def one(row: dict) -> dict:
            context.setLocalProperty("spark.scheduler.pool", f"row-{row['id']}")
            model = models.fit(models.build_estimator(row, p.label, n), train)
            shap = {r["feature"]: r["shap"] for r in explain(model, train, test, p.columns).collect()}
            return {"algo_id": row["id"], **evaluate(model, test, p.label), "shap": json.dumps(shap, sort_keys=True)}

        with ThreadPoolExecutor(workers) as pool:
            for row, future in [(row, pool.submit(one, row)) for row in rows]:
                try:
                    results.append(future.result())
                except Exception as e:  # noqa: BLE001 - the other rows go on
                    failed[row["id"]] = e
    finally:
        train.unpersist()
        test.unpersist()
    return results, failed


def run_experiment(
    store: ResultStore,
    name: str,
    dataset_id: int,
    target: str,
    categories: Sequence[str] = (),
    unused: Sequence[str] = (),
    impl_type: int | None = None,
    keys: Sequence[str] | None = None,
    impute: bool = True,
    partitions: int | None = None,
    workers: int = WORKERS,
    run: int | None = None,
) -> int:
    """Train the whole catalogue of one kind on a stored dataset. Returns the run id.

    ``impl_type`` defaults to how the dataset is stored. The run row is written after its details. If a row of the catalogue
    fails, the others are stored and :class:`ExperimentFailed` tells the run's id; called again with that ``run`` and the same
    arguments, only what is missing is trained.
    """
    dataset = store.get("dataset", dataset_id)
    impl_type = dataset["stored"] if impl_type is None else impl_type
    p = prepare(read_dataset(store, dataset_id), target, categories, unused, keys, impute=impute)
    done = set()
    if run is not None:
        done = {r["algo_id"] for r in store.read_all("experiment_detail", experiment_id=run).select("algo_id").collect()}
    results, failed = run_models(p, impl_type, partitions, workers, done)
    now = datetime.now(ZoneInfo("America/Los_Angeles")).replace(tzinfo=None)
    if run is None:
        (run,) = store.claim_ids("experiment")
    if results:
        details = store.claim_ids("experiment_detail", len(results))
        store.append_rows("experiment_detail", [{"id": i, "experiment_id": run, "created_date": now, **r} for i, r in zip(details, results)])
    if failed:
        raise ExperimentFailed(run, failed)
    store.append_rows(
        "experiment",
        [{"id": run, "experiment_name": name, "target_name": target, "features": ", ".join(p.features),
          "dataset_id": dataset_id, "created_date": now}],
    )
    return run


def best_models(store: ResultStore, dataset_id: int) -> DataFrame:
    """Best model per run of a dataset."""
    runs = store.read("experiment", dataset_id=dataset_id)
    own = store.read("experiment_detail").join(runs.select(F.col("id").alias("experiment_id")), "experiment_id", "left_semi")
    return best_models_of(runs, own, models.catalogue(store.spark)).orderBy("id")


def experiment_table(store: ResultStore, id: int) -> DataFrame:
    """All models of a run, best first."""
    store.get("experiment", id)
    return table_of(store.read("experiment_detail", experiment_id=id), models.catalogue(store.spark))


def shap_ranking(store: ResultStore, detail_id: int) -> DataFrame:
    """Features of a stored model by mean absolute Shapley value."""
    store.get("experiment_detail", detail_id)
    return ranking_of(store.read("experiment_detail", id=detail_id))
