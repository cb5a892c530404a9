"""Import a table: managed copy, profile, registration; append further files to it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.functions.columns import now_pacific
from modelscout.operators.profile import profile
from modelscout.operators.roles import suggest_roles, variable_summary
from modelscout.operators.sketches import sketch_columns
from modelscout.sources.store import ResultStore
from modelscout.sources.tables import conform, read_table, write_table


def import_dataset(
    spark: SparkSession,
    src: str,
    name: str,
    store: ResultStore,
    fmt: str = "csv",
    stored: int = 1,
    exact: bool = True,
    appendable: bool = True,
    **read_options,
) -> int:
    """Copy a table into the store as Parquet, profile the copy and register both. Returns the dataset id.

    An ``appendable`` dataset also keeps sketches of its columns, for one scan more; :func:`append_to_dataset` needs them. The id is settled before anything is written, and the dataset row is written last: a failed import leaves no
    registered dataset behind.
    """
    (id,) = store.claim_ids("dataset")
    path = f"{store.root}/data/{id}"
    write_table(read_table(spark, src, fmt, **read_options), path, mode="overwrite")
    df = read_table(spark, path)
    rows = df.count()
    store.append("dataset_summary", profile(df, exact=exact).withColumn("dataset_id", F.lit(id)))
    if appendable:
        _keep_sketches(store, df, id, 0)
    now = now_pacific()
    store.append(
        "dataset",
        spark.range(1).select(
            F.lit(id).alias("id"),
            F.lit(name).alias("dataset_name"),
            F.lit(path).alias("filepath"),
            F.lit(stored).alias("stored"),
            F.lit(rows).alias("row_number"),
            F.lit(len(df.columns)).alias("column_number"),
            now.alias("created_date"),
            now.alias("last_update"),
        ),
    )
    return id


def append_to_dataset(store: ResultStore, id: int, src: str, fmt: str = "csv", **read_options) -> int:
    """Add the rows of a file to an imported dataset. Returns the number of the part.

    The file must have the dataset's columns, in any order, with values of their types; otherwise ``ValueError``, and the dataset
    stays as it is. Only the new file is read: its sketches are stored beside those of the earlier parts, and summaries are merged
    from them. From then on the distinct counts and quartiles are approximate: 0.7 % standard error, and 0.2 % of the
    rows in rank. The part is registered last, so a failed append is not seen; several may run at once.
    """
    spark = store.spark
    path = store.get("dataset", id)["filepath"]
    if not store.read("dataset_sketch", dataset_id=id, part_id=0).take(1):
        raise ValueError(f"dataset {id} was imported without sketches")
    schema = read_table(spark, path).schema
    new = conform(read_table(spark, src, fmt, types=False, **read_options), schema)
    (part,) = store.claim_ids("dataset_part")
    copy = f"{store.root}/data_parts/{id}/{part}"
    write_table(new, copy, mode="overwrite")
    df = read_table(spark, copy, schema=schema)
    rows = df.count()
    _keep_sketches(store, df, id, part)
    store.append(
        "dataset_part",
        spark.range(1).select(
            F.lit(part).alias("id"),
            F.lit(id).alias("dataset_id"),
            F.lit(copy).alias("filepath"),
            F.lit(rows).alias("row_number"),
            now_pacific().alias("appended_date"),
        ),
    )
    return part


def _keep_sketches(store: ResultStore, df: DataFrame, id: int, part: int) -> None:
    store.append("dataset_sketch", sketch_columns(df).withColumns({"dataset_id": F.lit(id), "part_id": F.lit(part)}))


def read_dataset(store: ResultStore, id: int) -> DataFrame:
    """The managed copy of a dataset with all parts that were appended."""
    df = read_table(store.spark, store.get("dataset", id)["filepath"])
    parts = [r["filepath"] for r in store.read("dataset_part", dataset_id=id).select("filepath").collect()]
    return df.union(store.spark.read.schema(df.schema).parquet(*parts)) if parts else df


def list_datasets(store: ResultStore) -> DataFrame:
    return store.read("dataset").orderBy("id")


def dataset_variables(store: ResultStore, id: int) -> DataFrame:
    """The stored column summary of a dataset, for display."""
    rows = store.get("dataset", id)["row_number"]
    return variable_summary(store.read("dataset_summary", dataset_id=id), rows).orderBy("var_id")


def dataset_roles(store: ResultStore, id: int) -> DataFrame:
    return suggest_roles(store.read("dataset_summary", dataset_id=id)).orderBy("var_id")
