"""One query per operator over the shared test tables, used by the driver, the tests and the bench."""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.operators import charts, explain, metrics, models, outliers, prep, profile, ranking, roles
from modelscout.operators.impute import KnnImpute
from modelscout.operators.penalized import PenalizedLogisticModel
from modelscout.plans import derived, experiments, importing, preparing
from modelscout.sources import ResultStore, read_table, scratch_path, write_table

LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_linenumber"]
CORRELATED_WEIGHTS = {"l_quantity": 0.02, "l_extendedprice": -0.0001}
SHAP_WEIGHTS = {"l_quantity": 0.02, "l_discount": 1.5, "l_tax": -2.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded for comparison; ``own`` sets the digits of single columns."""
    return df.select(
        [F.round(F.col(f"`{c}`"), own.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


# ---- derived inputs -------------------------------------------------------------------------------------------


def gappy_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumns(
        {
            "l_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")),
            "l_tax": F.when(F.col("l_suppkey") % 11 != 0, F.col("l_tax")),
            "l_returnflag": F.when(F.col("l_orderkey") % 13 != 0, F.col("l_returnflag")),
        }
    )


def gappy_part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_brand",
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey") * 37 % 101).cast("double").alias("p_weight"),
    )


def scored_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "F").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_discount") * 10 >= 0.5).cast("int").alias("prediction"),
    )


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a target that the quantity tells about: is the line worth at least the mean?"""
    lines = table(spark, sf, "lineitem").withColumn("worth", F.col("l_quantity") * F.col("l_extendedprice"))
    flagged = prep.flag_at_least(lines, "worth", prep.Mean("worth"), "high_worth")
    return flagged.select(*LINEITEM_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "high_worth")


def prepared_model_table(spark: SparkSession, sf: str) -> preparing.Prepared:
    return preparing.prepare(
        model_table(spark, sf), "high_worth", ["l_returnflag", "l_linestatus"], LINEITEM_KEY, keys=LINEITEM_KEY
    )


def dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return nations.select(
        F.col("c_nationkey").cast("bigint").alias("id"),
        F.concat(F.lit("customers of nation "), F.col("c_nationkey").cast("string")).alias("dataset_name"),
        (F.col("c_nationkey") % 2).alias("stored"),
        F.col("n").alias("row_number"),
        F.lit(5).alias("column_number"),
    )


def experiment_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("experiment_name"),
        F.col("c_mktsegment").alias("target_name"),
        F.concat_ws(", ", F.lit("c_acctbal"), F.col("c_mktsegment")).alias("features"),
        F.col("c_nationkey").cast("bigint").alias("dataset_id"),
    )


def detail_rows(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("experiment_id"),
        (rank + F.when(F.col("o_orderstatus") == "F", 5).otherwise(0)).alias("algo_id"),
        F.round(F.col("o_totalprice") / 1000000, 6).alias("auc"),
        ((F.col("o_orderkey") % 100).cast("double") / 100).alias("precision"),
        ((F.col("o_orderkey") % 10).cast("double") / 10).alias("recall"),
        ((F.col("o_custkey") % 100).cast("double") / 100).alias("accuracy"),
    )


def new_store(spark: SparkSession) -> ResultStore:
    return ResultStore(spark, scratch_path(spark, "store"))


def filled_store(spark: SparkSession, sf: str, *tables: str) -> ResultStore:
    rows = {"dataset": dataset_rows, "experiment": experiment_rows, "experiment_detail": detail_rows}
    store = new_store(spark)
    for name in tables:
        store.append(name, rows[name](spark, sf))
    return store


# ---- sources and stores ---------------------------------------------------------------------------------------


def csv_round_trip(spark, sf):
    events = table(spark, sf, "events")
    path = write_table(events, scratch_path(spark, "csv"), "csv")
    return read_table(spark, path, "csv", schema=events.schema)


def tsv_round_trip(spark, sf):
    path = write_table(table(spark, sf, "part"), scratch_path(spark, "tsv"), "tsv", compression="gzip")
    return prep.cast_columns(read_table(spark, path, "tsv"), {"p_partkey": "bigint"})


def csv_documents(spark, sf):
    """Whole texts with line breaks, quotes and outer blanks."""
    documents = table(spark, sf, "documents")
    path = write_table(documents, scratch_path(spark, "csv"), "csv")
    return read_table(spark, path, "csv", schema=documents.schema)


def csv_documents_one_file(spark, sf):
    """Whole texts written as one file, which many tasks read."""
    documents = table(spark, sf, "documents")
    path = write_table(documents.coalesce(1), scratch_path(spark, "csv"), "csv")
    return read_table(spark, path, "csv", schema=documents.schema)


def tsv_conversations(spark, sf):
    path = write_table(table(spark, sf, "conversations"), scratch_path(spark, "tsv"), "tsv", compression="gzip")
    return prep.cast_columns(read_table(spark, path, "tsv"), {"conv_id": "bigint", "turn": "bigint"})


def import_documents(spark, sf):
    src = write_table(table(spark, sf, "documents"), scratch_path(spark, "src"), "csv")
    store = new_store(spark)
    id = importing.import_dataset(spark, src, "documents", store)
    return rounded(store.read("dataset_summary", dataset_id=id).drop("dataset_id"))


def parquet_round_trip(spark, sf):
    path = write_table(table(spark, sf, "lineitem"), scratch_path(spark, "parquet"), "parquet")
    return read_table(spark, path, "parquet")


def import_dataset(spark, sf):
    src = write_table(table(spark, sf, "customer"), scratch_path(spark, "src"), "csv")
    store = new_store(spark)
    id = importing.import_dataset(spark, src, "customer", store)
    shape = store.read("dataset").select(F.col("id").alias("dataset_id"), "dataset_name", "row_number", "column_number")
    summary = store.read("dataset_summary", dataset_id=id)
    return rounded(summary.join(shape, "dataset_id").drop("dataset_id"))


def append_to_dataset(spark, sf):
    """The customers imported in three parts; counts, moments and ends of the whole come from the parts' sketches."""
    customer = table(spark, sf, "customer")
    part = F.pmod("c_custkey", F.lit(3))
    first, *more = [write_table(customer.filter(part == i), scratch_path(spark, "src"), "csv") for i in range(3)]
    store = new_store(spark)
    id = importing.import_dataset(spark, first, "customer", store)
    for src in more:
        importing.append_to_dataset(store, id, src)
    shape = store.read("dataset").select(F.col("id").alias("dataset_id"), "row_number")
    summary = store.read("dataset_summary", dataset_id=id).join(shape, "dataset_id")
    return rounded(summary).select("var_id", "var_name", "var_type", "ds_count", "ds_mean", "ds_std", "ds_min", "ds_max", "row_number")


def result_store_round_trip(spark, sf):
    store = filled_store(spark, sf, "experiment", "experiment_detail")
    found = store.read("experiment_detail")
    return found.select("id", "experiment_id", "algo_id", "auc", "precision", "recall", "accuracy")


def metadata_filter(spark, sf):
    found = filled_store(spark, sf, "experiment").read("experiment", dataset_id=7)
    return found.select("id", "experiment_name", "target_name", "features", "dataset_id")


def list_datasets(spark, sf):
    found = importing.list_datasets(filled_store(spark, sf, "dataset"))
    return found.select("id", "dataset_name", "stored", "row_number", "column_number")


def delete_dataset(spark, sf):
    store = filled_store(spark, sf, "dataset", "experiment")
    store.delete_dataset(3)
    counts = store.read("experiment").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("runs"))
    names = store.read("dataset").select(F.col("id").alias("dataset_id"), "dataset_name")
    return names.join(counts, "dataset_id", "full")


# ---- profile --------------------------------------------------------------------------------------------------


def table_shape(spark, sf):
    return profile.table_shape(table(spark, sf, "lineitem"))


def profile_numeric(spark, sf):
    found = profile.profile(gappy_lineitem(spark, sf))
    return rounded(found.filter(F.col("var_type") == profile.NUMERIC))


def profile_approx(spark, sf):
    return profile.profile(gappy_lineitem(spark, sf), exact=False)


def profile_string(spark, sf):
    found = profile.profile(table(spark, sf, "documents"))
    return found.filter(F.col("var_type") == profile.STRING)


def top_value(spark, sf):
    return profile.top_value(gappy_lineitem(spark, sf), ["l_linenumber", "l_returnflag", "l_linestatus"])


def distinct_counts(spark, sf):
    return profile.distinct_counts(gappy_lineitem(spark, sf))


def distinct_counts_with_null(spark, sf):
    return profile.distinct_counts(gappy_lineitem(spark, sf), count_null=True)


def missing_counts(spark, sf):
    return profile.missing_counts(gappy_lineitem(spark, sf))


def quality_report(spark, sf):
    df = gappy_lineitem(spark, sf)
    notes = roles.quality_report(profile.profile(df, quartiles=False), profile.table_shape(df).select("row_number").scalar())
    people = table(spark, sf, "customer")
    more = roles.quality_report(profile.profile(people, quartiles=False), profile.table_shape(people).select("row_number").scalar())
    return notes.unionByName(more)


def quality_report_outliers(spark, sf):
    """Notes on customers and events, the outlier test included."""
    out = []
    for name in ("customer", "events"):
        df = table(spark, sf, name)
        summary = profile.profile(df, quartiles=False)
        rows = profile.table_shape(df).select("row_number").scalar()
        report = roles.quality_report(summary, rows, outliers.columns_with_outliers(summary))
        out.append(report.withColumn("table", F.lit(name)))
    return out[0].unionByName(out[1])


def variable_summary(spark, sf):
    df = table(spark, sf, "lineitem")
    return roles.variable_summary(profile.profile(df), profile.table_shape(df).select("row_number").scalar())


def suggest_roles(spark, sf):
    found = [roles.suggest_roles(profile.profile(table(spark, sf, n), quartiles=False)) for n in ("lineitem", "customer", "labels")]
    return reduce(DataFrame.unionByName, found)


def value_counts(spark, sf):
    return profile.value_counts(gappy_lineitem(spark, sf), "l_returnflag")


def histogram_numeric(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


def box_stats(spark, sf):
    return rounded(charts.box_stats(table(spark, sf, "events"), "value"))


def preview(spark, sf):
    return charts.preview(table(spark, sf, "orders"), 10, [F.desc("o_totalprice"), "o_orderkey"])


def sample_about(spark, sf):
    return charts.sample_about(table(spark, sf, "events"), 1000, key=["event_id"]).select("event_id", "value")


def grubbs_statistic(spark, sf):
    return rounded(outliers.grubbs_statistic(table(spark, sf, "events"), "value", ["event_type"]))


def grubbs_outliers(spark, sf):
    return outliers.grubbs_outliers(table(spark, sf, "events"), "value", by=["event_type"])


# ---- preparation ----------------------------------------------------------------------------------------------


def select_features(spark, sf):
    chosen = prep.select_features(
        table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority", "o_orderdate"], ["o_orderdate", "o_custkey"]
    )
    return chosen.df.withColumns(
        {"features": F.lit(", ".join(chosen.features)), "categories": F.lit(", ".join(chosen.categories))}
    )


def drop_sentinel(spark, sf):
    marked = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "\\N").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    return prep.drop_sentinel(marked, ["status", "priority"])


def filter_between(spark, sf):
    return prep.filter_between(table(spark, sf, "lineitem"), "l_quantity", 10, 20)


def cast_columns(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.regexp_replace("o_orderpriority", "-.*", "").alias("rank"), "o_orderstatus"
    )
    return prep.cast_columns(orders, {"o_custkey": "string", "rank": "int", "o_orderstatus": "int"})


def drop_incomplete(spark, sf):
    return prep.drop_incomplete(gappy_part(spark, sf))


def _flag(spark, sf, threshold):
    lines = prep.flag_at_least(table(spark, sf, "lineitem"), "l_extendedprice", threshold, "flag")
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "flag")


def flag_weighted_mean(spark, sf):
    return _flag(spark, sf, prep.WeightedMean("l_extendedprice", "l_quantity"))


def flag_mean(spark, sf):
    return _flag(spark, sf, prep.Mean("l_extendedprice"))


def flag_constant(spark, sf):
    return _flag(spark, sf, prep.WeightedMean(80000, "l_quantity"))


def weighted_mean(spark, sf):
    return rounded(prep.weighted_mean(gappy_lineitem(spark, sf), "l_extendedprice", "l_quantity"))


def left_join(spark, sf):
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    # some lines name a part that does not exist
    key = F.when(F.col("l_partkey") % 3 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("l_partkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key, "l_quantity")
    return prep.enrich(lines, parts.select("l_partkey", "p_brand", "p_size"), "l_partkey")


def explode_delimited(spark, sf):
    return prep.explode_delimited(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ")


def train_test_split(spark, sf):
    train, test = prep.split(table(spark, sf, "orders"), ["o_orderkey"])
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.select("o_orderkey", "side")


def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("status")
    )
    return prep.one_hot(orders, ["o_orderpriority", "status"])


def one_hot_aligned(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    train, test = prep.one_hot_aligned(*prep.split(suppliers, ["s_suppkey"]), ["nation"])
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    dummies = [c for c in sides.columns if c.startswith("nation_")]
    return sides.unpivot(["s_suppkey", "side"], dummies, "dummy", "value")


def columns_to_impute(spark, sf):
    train, test = prep.split(gappy_lineitem(spark, sf), LINEITEM_KEY)
    found = set(prep.columns_to_impute(train, test))
    gaps = profile.missing_counts(gappy_lineitem(spark, sf))
    return gaps.filter(F.col("var_name").isin(found)).select("var_name", "missing")


def knn_impute(spark, sf):
    parts = gappy_part(spark, sf)
    train, _ = prep.split(parts, ["p_partkey"])
    filled = KnnImpute(["p_size", "p_retailprice", "p_weight"]).fit(train).transform(parts)
    return rounded(filled.drop("p_brand"))


def prepare_features(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "yes").otherwise("no").alias("urgent"),
    )
    p = preparing.prepare(
        orders, "urgent", ["o_orderstatus", "urgent", "o_orderdate"], ["o_orderkey", "o_orderdate"], keys=["o_orderkey"]
    )
    sides = p.train.withColumn("side", F.lit("train")).unionByName(p.test.withColumn("side", F.lit("test")))
    return rounded(sides.withColumn("features", F.lit(", ".join(p.features))), 2)


def derived_flags(spark, sf):
    parts = table(spark, sf, "part").withColumn(
        "kind", F.when(F.col("p_type") == "SMALL", "\\N").otherwise(F.col("p_type"))
    )
    items = prep.explode_delimited(prep.drop_sentinel(parts, ["kind"]), "p_name", " ")
    kept = prep.filter_between(items, "p_size", 10, 40).select("p_partkey", "p_name", "kind")
    # the sales of some parts go by another key, so these parts have none
    key = F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    sales = table(spark, sf, "lineitem").groupBy(key.alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("sold")
    )
    whole = prep.drop_incomplete(prep.enrich(kept, sales, "p_partkey"))
    return derived.rating_flags(whole, "price", "sold", ("price_high", "sold_high", "price_above"), 80000)


# ---- result tables --------------------------------------------------------------------------------------------


def leaderboard_join(spark, sf):
    rows = ranking.leaderboard_rows(experiment_rows(spark, sf), detail_rows(spark, sf), models.catalogue(spark))
    return rows.select("experiment_id", "experiment_name", "dataset_id", "algo_id", "algo_name", "auc")


def best_model_per_experiment(spark, sf):
    return ranking.best_models(experiment_rows(spark, sf), detail_rows(spark, sf), models.catalogue(spark))


def experiment_table(spark, sf):
    return ranking.experiment_table(detail_rows(spark, sf), models.catalogue(spark)).drop("parameters")


def algorithm_catalogue(spark, sf):
    used = detail_rows(spark, sf).groupBy("algo_id").agg(F.count(F.lit(1)).alias("runs"))
    names = models.catalogue(spark).select(F.col("id").alias("algo_id"), "impl_type", "algo_type", "algo_name")
    return names.join(used, "algo_id")


def shap_ranking(spark, sf):
    details = detail_rows(spark, sf)
    values = details.select(
        "id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("shap")) for c in ("auc", "recall")]))
    )
    return ranking.shap_ranking(ranking.shap_to_json(values, "id"))


# ---- metrics, models, explanation -----------------------------------------------------------------------------


def confusion_counts(spark, sf):
    return metrics.confusion(scored_lineitem(spark, sf), "y", "prediction")


def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(scored_lineitem(spark, sf), "y", "prediction"), 6)


def weighted_metrics(spark, sf):
    return rounded(metrics.weighted_metrics(scored_lineitem(spark, sf), "y", "prediction"), 6)


def auc_score(spark, sf):
    ties = rounded(metrics.auc(scored_lineitem(spark, sf), "y", "score"), 6).withColumn("score", F.lit("discount"))
    lines = table(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "F").cast("int"))
    wide = rounded(metrics.auc(lines, "y", "l_extendedprice"), 6).withColumn("score", F.lit("price"))
    return ties.unionByName(wide)


def auc_hard_label(spark, sf):
    return rounded(metrics.auc(scored_lineitem(spark, sf), "y", "prediction"), 6)


def linear_shap_fixed_weights(spark, sf):
    train, test = prep.split(table(spark, sf, "lineitem"), LINEITEM_KEY)
    return rounded(explain.linear_shap(SHAP_WEIGHTS, train, test), 6)


def linear_shap_correlated_fixed_weights(spark, sf):
    train, test = prep.split(table(spark, sf, "lineitem"), LINEITEM_KEY)
    return rounded(explain.linear_shap_correlated(CORRELATED_WEIGHTS, train, test), 6)


def linear_values_fixed_weights(spark, sf):
    train, test = prep.split(table(spark, sf, "lineitem"), LINEITEM_KEY)
    return rounded(explain.linear_values(SHAP_WEIGHTS, train, test, LINEITEM_KEY, correlated=False), 6)


def score_fixed_weights(spark, sf):
    """Assembled features scored by a linear model whose weights are given."""
    lines = table(spark, sf, "lineitem").withColumn("label", (F.col("l_linestatus") == "F").cast("int"))
    model = PenalizedLogisticModel(np.array(list(SHAP_WEIGHTS.values())), -0.3, "features", 0.0)
    scored = models.score(model, prep.assemble(lines, list(SHAP_WEIGHTS)), "label", keep=tuple(LINEITEM_KEY))
    return rounded(scored, 6)


def _fitted(spark, sf, id):
    p = prepared_model_table(spark, sf)
    train, test = preparing.vectors(p, spark.sparkContext.defaultParallelism)
    train = train.persist()
    try:
        n = train.count()
        model = models.fit(models.build_estimator(models.catalogue_row(id), p.label, n), train)
    finally:
        train.unpersist()
    return p, train, test, model


def _score(id):
    def run(spark, sf):
        p, _, test, model = _fitted(spark, sf, id)
        return models.score(model, test, p.label)

    return run


def linear_shap(spark, sf):
    p, train, test, model = _fitted(spark, sf, 7)
    return explain.explain(model, train, test, p.columns)


def tree_shap(spark, sf):
    p, train, test, model = _fitted(spark, sf, 9)
    return explain.explain(model, train, test, p.columns)


def shap_values(spark, sf):
    p, _, test, model = _fitted(spark, sf, 8)
    keyed = test.withColumn("row", F.xxhash64(*p.columns))
    return explain.shap_values(model, keyed, p.columns, ["row"])


def run_experiment(spark, sf):
    src = write_table(model_table(spark, sf), scratch_path(spark, "src"), "csv")
    store = new_store(spark)
    id = importing.import_dataset(spark, src, "lines", store)
    run = experiments.run_experiment(
        store, "worth of lines", id, "high_worth", ["l_returnflag", "l_linestatus"], LINEITEM_KEY, keys=LINEITEM_KEY,
        partitions=spark.sparkContext.defaultParallelism,
    )
    return experiments.experiment_table(store, run)


def run_local_experiment(spark, sf):
    """The six local rows on a dataset with gaps, imputed, explained and stored."""
    rows = gappy_lineitem(spark, sf).drop("l_shipdate").withColumn("late", (F.col("l_linestatus") == "F").cast("int")).drop("l_linestatus")
    src = write_table(rows, scratch_path(spark, "src"), "csv")
    store = new_store(spark)
    id = importing.import_dataset(spark, src, "lines with gaps", store, stored=0)
    run = experiments.run_experiment(store, "late lines", id, "late", ["l_returnflag"], LINEITEM_KEY, keys=LINEITEM_KEY)
    return experiments.experiment_table(store, run)


SCORES = {
    "score_local_lasso": 0,
    "score_local_forest": 1,
    "score_local_stumps": 2,
    "score_local_deep_boosted": 3,
    "score_local_logistic": 4,
    "score_local_ridge": 5,
    "score_lasso": 6,
    "score_ridge": 7,
    "score_forest": 8,
    "score_boosted": 9,
}

QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_documents, csv_documents_one_file, tsv_round_trip, tsv_conversations, parquet_round_trip, import_dataset, import_documents, append_to_dataset, result_store_round_trip, metadata_filter,
        list_datasets, delete_dataset, table_shape, profile_numeric, profile_approx, profile_string, top_value,
        distinct_counts, distinct_counts_with_null, missing_counts, quality_report, quality_report_outliers, variable_summary, suggest_roles,
        value_counts, histogram_numeric, box_stats, preview, sample_about, grubbs_statistic, grubbs_outliers,
        select_features, drop_sentinel, filter_between, cast_columns, drop_incomplete, flag_weighted_mean, flag_mean,
        flag_constant, weighted_mean, left_join, explode_delimited, train_test_split, one_hot, one_hot_aligned,
        columns_to_impute, knn_impute, prepare_features, derived_flags, leaderboard_join,
        best_model_per_experiment, experiment_table, algorithm_catalogue, shap_ranking, confusion_counts,
        binary_metrics, weighted_metrics, auc_score, auc_hard_label, linear_shap_fixed_weights,
        linear_shap_correlated_fixed_weights, linear_values_fixed_weights, score_fixed_weights, linear_shap, tree_shap,
        shap_values, run_experiment, run_local_experiment,
    )
} | {name: _score(id) for name, id in SCORES.items()}
