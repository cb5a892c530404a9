"""Append-only Parquet tables for datasets, summaries, runs and run details."""
from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.functions.columns import now_pacific
from modelscout.operators.sketches import merge_sketches

# Fixed table layouts.
SCHEMAS = {
    "dataset": "id BIGINT, dataset_name STRING, filepath STRING, stored INT, row_number BIGINT, column_number INT, "
    "created_date TIMESTAMP_NTZ, last_update TIMESTAMP_NTZ",
    "dataset_summary": "dataset_id BIGINT, var_id INT, var_name STRING, var_type INT, ds_count BIGINT, "
    "ds_unique BIGINT, ds_mean DOUBLE, ds_std DOUBLE, ds_min DOUBLE, ds_25 DOUBLE, ds_50 DOUBLE, ds_75 DOUBLE, "
    "ds_max DOUBLE",
    "experiment": "id BIGINT, experiment_name STRING, target_name STRING, features STRING, dataset_id BIGINT, "
    "created_date TIMESTAMP_NTZ",
    "experiment_detail": "id BIGINT, experiment_id BIGINT, algo_id INT, auc DOUBLE, precision DOUBLE, recall DOUBLE, "
    "accuracy DOUBLE, auc_hard DOUBLE, weighted_precision DOUBLE, weighted_recall DOUBLE, shap STRING, "
    "created_date TIMESTAMP_NTZ",
    "dataset_deleted": "dataset_id BIGINT, deleted_date TIMESTAMP_NTZ",
    "dataset_part": "id BIGINT, dataset_id BIGINT, filepath STRING, row_number BIGINT, appended_date TIMESTAMP_NTZ",
    # part 0 is what was imported
    "dataset_sketch": "dataset_id BIGINT, part_id BIGINT, var_id INT, var_name STRING, var_type INT, ds_count BIGINT, "
    "mean DOUBLE, squares DOUBLE, low DOUBLE, high DOUBLE, quantiles BINARY, distinct BINARY",
}
# Folder partitioning; the other tables rely on sorted files and row-group statistics.
PARTITIONS = {"dataset_summary": ["dataset_id"], "experiment": ["dataset_id"], "dataset_sketch": ["dataset_id"]}
SORT = {"experiment_detail": "experiment_id", "dataset": "id"}
DATASET_KEY = {"dataset": "id", "dataset_summary": "dataset_id", "experiment": "dataset_id", "dataset_part": "dataset_id",
               "dataset_sketch": "dataset_id"}


class ResultStore:
    """Result tables under one root folder. Rows are only ever appended; deletion appends a tombstone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in SCHEMAS:
            raise ValueError(f"unknown result table {table!r}")
        return f"{self.root}/{table}"

    def append(self, table: str, df: DataFrame) -> None:
        """Append rows; columns the frame lacks become NULL.

        Every call has a folder of its own: Spark's writers keep unfinished files in the folder they write to and clear it
        when they are done, those of another writer included.
        """
        path = f"{self.path(table)}/append={uuid.uuid4().hex}"
        wanted = self.spark.createDataFrame([], SCHEMAS[table]).schema
        have = set(df.columns)
        rows = df.select(
            [
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in wanted.fields
            ]
        )
        keys = PARTITIONS.get(table, [])
        order = keys or [SORT[table]] if (keys or table in SORT) else []
        if order:
            rows = rows.sortWithinPartitions(*order)
        rows.write.partitionBy(*keys).parquet(path)

    def append_rows(self, table: str, rows: list[dict]) -> None:
        """Append a handful of driver-side records (one run, one dataset)."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        data = [tuple(r.get(n) for n in schema.names) for r in rows]
        self.append(table, self.spark.createDataFrame(data, schema).coalesce(1))

    def read(self, table: str, **eq) -> DataFrame:
        """The live rows of a table, filtered by equality; rows of deleted datasets are hidden.

        Rows and summaries of datasets are those of all their parts. They are put together here from what every
        part wrote, so that parts which are appended at the same time do not overwrite each other.
        """
        df = self._raw(table)
        if table == "dataset":
            df = self._with_parts(df)
        elif table == "dataset_summary":
            df = self._summaries(df)
        for name, value in eq.items():
            df = df.filter(F.col(name) == F.lit(value))
        key = DATASET_KEY.get(table)
        if key:
            gone = self._raw("dataset_deleted").select(F.col("dataset_id").alias(key)).distinct()
            df = df.join(gone, key, "left_anti")
        elif table == "experiment_detail":
            live = self.read("experiment").select(F.col("id").alias("experiment_id"))
            df = df.join(live, "experiment_id", "left_semi")
        return df

    def _with_parts(self, datasets: DataFrame) -> DataFrame:
        parts = self._raw("dataset_part").groupBy(F.col("dataset_id").alias("id")).agg(
            F.sum("row_number").alias("_more"), F.max("appended_date").alias("_last")
        )
        joined = datasets.join(parts, "id", "left")
        own = {
            "row_number": F.col("row_number") + F.coalesce("_more", F.lit(0)),
            "last_update": F.greatest("last_update", "_last"),
        }
        return joined.select([own.get(c, F.col(c)).alias(c) for c in datasets.columns])

    def _summaries(self, imported: DataFrame) -> DataFrame:
        parts = self._raw("dataset_part")
        grown = parts.select("dataset_id").distinct()
        wanted = parts.select("dataset_id", F.col("id").alias("part_id")).union(grown.select("dataset_id", F.lit(0).cast("bigint")))
        sketches = self._raw("dataset_sketch").join(wanted, ["dataset_id", "part_id"], "left_semi")
        merged = merge_sketches(sketches, ("dataset_id",))
        return imported.join(grown, "dataset_id", "left_anti").select(imported.columns).unionByName(merged)

    def read_all(self, table: str, **eq) -> DataFrame:
        """Rows of a table filtered by equality, also those of deleted datasets and of runs that are not complete."""
        df = self._raw(table)
        for name, value in eq.items():
            df = df.filter(F.col(name) == F.lit(value))
        return df

    def get(self, table: str, id: int):
        """One row by primary key; ``KeyError`` when it is missing or deleted."""
        row = self.read(table, id=id).limit(1).first()
        if row is None:
            raise KeyError(f"{table} {id} not found")
        return row

    def next_id(self, table: str) -> int:
        """The smallest id above all ids of the table, deleted ones included. Writers take ids by :meth:`claim_ids`."""
        top = self._raw(table).agg(F.max("id")).first()[0]
        return 1 if top is None else top + 1

    def claim_ids(self, table: str, n: int = 1) -> list[int]:
        """``n`` ids that no other writer gets, in ascending order.

        An id belongs to whoever creates the file of its name, which a file system lets happen once. Ids that were claimed and
        never written stay unused. The claims of written ids are below the start of the search and not looked at again.
        """
        folder = f"{self.path(table)}_ids"
        out, at = [], self.next_id(table)
        while len(out) < n:
            if self._create(f"{folder}/{at}"):
                out.append(at)
            at += 1
        return out

    def _create(self, path: str) -> bool:
        """Create an empty file; False if there is one already."""
        jvm = self.spark.sparkContext._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        system = file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(file.getParent())
        try:
            if system.getScheme() == "file":
                # Hadoop's view of a local disk looks first and creates then; the disk itself does both at once
                place = system.makeQualified(file).toUri().getPath()
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(place).toPath(), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                system.create(file, False).close()
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def delete_dataset(self, id: int) -> None:
        """Hide a dataset and everything that hangs on it."""
        self.get("dataset", id)
        rows = self.spark.range(1).select(F.lit(id).alias("dataset_id"), now_pacific().alias("deleted_date"))
        self.append("dataset_deleted", rows)

    def _raw(self, table: str) -> DataFrame:
        path, schema = self.path(table), SCHEMAS[table]
        try:
            found = self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        # partition columns come last in the files; keep the declared order, without the name of the append
        return found.select(self.spark.createDataFrame([], schema).columns)
