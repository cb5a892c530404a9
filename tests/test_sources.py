import os
import threading

import numpy as np
import pytest

from modelscout.operators.profile import profile
from modelscout.plans import importing
from modelscout.sources import ResultStore, materialize, read_table, scratch_path, write_table
from modelscout.sources.scratch import scratch
from modelscout.sources.tables import normalize_path


def test_s3_scheme():
    assert normalize_path("s3://b/k") == "s3a://b/k"
    assert normalize_path("s3a://b/k") == "s3a://b/k"
    assert normalize_path("/data/s3:x") == "/data/s3:x"


def test_csv_quotes_and_gaps(spark, make):
    df = make([(1, 'say "hi", you'), (2, None), (3, "back\\slash")], "id int, t string")
    path = write_table(df, scratch_path(spark, "t"), "csv")
    back = read_table(spark, path, "csv").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi", you'), (2, None), (3, "back\\slash")]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_text_keeps_every_row_and_character(spark, make, fmt):
    rows = [(1, " a "), (2, "x\ny"), (3, "cr\r\nlf"), (4, 'q"u"o,t\te'), (5, "\t"), (6, None), (7, "\\N"), (8, "end\\"), (9, '"'), (10, ","), (11, "\n"), (12, "é😀")]
    df = make(rows, "id int, t string").repartition(3)
    path = write_table(df, scratch_path(spark, "t"), fmt)
    assert sorted(tuple(r) for r in read_table(spark, path, fmt, schema=df.schema).collect()) == rows
    assert sorted(tuple(r) for r in read_table(spark, path, fmt).collect()) == rows
    # an empty text comes back as a missing one
    path = write_table(make([(1, ""), (2, None)], "id int, t string"), scratch_path(spark, "t"), fmt)
    assert {tuple(r) for r in read_table(spark, path, fmt).collect()} == {(1, None), (2, None)}


def test_types_do_not_depend_on_markers(spark, make):
    df = make([("1", "5000000000", "1.5", "2024-02-03", "2024-02-03 04:05:06", "true", "3D", None)], "a string, b string, c string, d string, e string, f string, g string, h string")
    path = write_table(df, scratch_path(spark, "t"), "csv")
    want = [("a", "int"), ("b", "bigint"), ("c", "double"), ("d", "date"), ("e", "timestamp_ntz"), ("f", "boolean"), ("g", "string"), ("h", "string")]
    for markers in ((), ("NA",), ("NA", "-")):
        assert read_table(spark, path, "csv", null_values=markers).dtypes == want


class Cluster:
    """A session that is not in one process and has no shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Cluster, "t")


def test_null_markers(spark, make):
    df = make([("1", "\\N", "x"), ("NA", "2.5", "\\N"), ("3", "1", "NA")], "a string, b string, c string")
    path = write_table(df, scratch_path(spark, "t"), "tsv")
    one = read_table(spark, path, "tsv", null_values=["\\N"])
    assert dict(one.dtypes) == {"a": "string", "b": "double", "c": "string"}
    two = read_table(spark, path, "tsv", null_values=["\\N", "NA"])
    assert dict(two.dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert sorted(two.collect(), key=str)[0] is not None
    assert {tuple(r) for r in two.collect()} == {(1, None, "x"), (None, 2.5, None), (3, 1.0, None)}
    typed = read_table(spark, path, "tsv", schema="a int, b double, c string", null_values=["\\N", "NA"])
    assert dict(typed.dtypes)["a"] == "int"


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere", "orc")


def test_materialize_keeps_rows_and_types(make):
    df = make([(1, [1.0, 2.0]), (2, None)], "id int, a array<double>")
    back = materialize(df, "t")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


@pytest.fixture
def store(spark):
    return ResultStore(spark, scratch_path(spark, "store"))


def test_store_is_empty_at_first(store):
    assert store.read("dataset").count() == 0
    assert store.next_id("experiment") == 1
    with pytest.raises(KeyError):
        store.get("dataset", 1)
    with pytest.raises(ValueError):
        store.path("secrets")


def test_import_then_delete(spark, make, store):
    df = make([(1, "a", None), (2, "b", 1.5), (2, "c", 2.5)], "n int, s string, x double")
    src = write_table(df, scratch_path(spark, "src"), "csv")
    id = importing.import_dataset(spark, src, "tiny", store)
    row = store.get("dataset", id)
    assert (row["row_number"], row["column_number"], row["dataset_name"]) == (3, 3, "tiny")
    assert importing.read_dataset(store, id).count() == 3
    shown = {r["variable"]: r for r in importing.dataset_variables(store, id).collect()}
    assert shown["x"]["quality"] == "missing values(1)" and shown["s"]["quality"] == "too many unique"
    assert shown["s"]["mean"] == "-" and shown["x"]["q50"] == "2.0000"
    picked = {r["var_name"]: r for r in importing.dataset_roles(store, id).collect()}
    assert picked["n"]["target_candidate"] == 1 and picked["s"]["unused"] == 1 and picked["s"]["category"] == 1
    store.append_rows("experiment", [{"id": 1, "experiment_name": "e", "dataset_id": id}])
    store.append_rows("experiment_detail", [{"id": 1, "experiment_id": 1, "algo_id": 6, "auc": 0.5}])
    assert store.read("experiment_detail", experiment_id=1).count() == 1
    other = importing.import_dataset(spark, src, "again", store)
    store.delete_dataset(id)
    assert [r["id"] for r in importing.list_datasets(store).collect()] == [other]
    for table in ("experiment", "experiment_detail"):
        assert store.read(table).count() == 0
    assert store.read("dataset_summary", dataset_id=id).count() == 0
    with pytest.raises(KeyError):
        store.delete_dataset(id)
    assert store.next_id("dataset") == other + 1


def test_two_writers_never_share_an_id(spark, tmp_path):
    """Each appends 50 runs, some of them at once; no id comes twice, none is lost, and a claim without a row is passed over."""
    root, taken = str(tmp_path), {}

    def write(name):
        store = ResultStore(spark, root)
        taken[name] = []
        for k in range(5):
            ids = store.claim_ids("experiment", 10)
            store.append_rows("experiment", [{"id": i, "experiment_name": name, "dataset_id": 1} for i in ids])
            taken[name] += ids

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = [(r["id"], r["experiment_name"]) for r in ResultStore(spark, root).read("experiment").collect()]
    assert len(rows) == 100 and len({i for i, _ in rows}) == 100
    assert sorted(rows) == sorted((i, n) for n, ids in taken.items() for i in ids)
    store = ResultStore(spark, root)
    (lost,) = store.claim_ids("experiment")
    assert store.claim_ids("experiment", 2) == [lost + 1, lost + 2] and lost > max(i for i, _ in rows)


def test_scratch_tables_of_a_block_are_deleted(spark, make):
    path = scratch_path(spark, "kept")
    with scratch(spark):
        inner = materialize(make([(1,), (2,)], "i int"), "inner")
        inside = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inside)
        with scratch(spark):
            deeper = materialize(inner, "deeper").inputFiles()[0].removeprefix("file://")
        assert not os.path.exists(deeper) and os.path.exists(inside)
        inner.write.parquet(path)
    assert not os.path.exists(inside) and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError), scratch(spark):
        gone = materialize(make([(1,)], "i int"), "inner").inputFiles()[0].removeprefix("file://")
        raise ValueError
    assert not os.path.exists(gone) and os.path.dirname(materialize(make([(1,)], "i int"), "x").inputFiles()[0]).count("scope") == 0


def appended(spark, make, store, x, parts):
    """Datasets of (n, x, s): the first part imported, the others appended."""
    rows = [(i, None if i % 7 == 0 else float(v), f"s{i % 5000}") for i, v in enumerate(x)]
    cut = [rows[i::parts] for i in range(parts)]
    schema = "n int, x double, s string"
    srcs = [write_table(make(c, schema), scratch_path(spark, "src"), "csv") for c in cut]
    id = importing.import_dataset(spark, srcs[0], "grown", store)
    for src in srcs[1:]:
        importing.append_to_dataset(store, id, src)
    return id, make(rows, schema), rows


def test_summary_of_parts_is_that_of_the_whole(spark, make, store):
    rng = np.random.default_rng(3)
    id, whole, rows = appended(spark, make, store, np.exp(rng.normal(10, 3, 30_000)), 3)
    assert store.get("dataset", id)["row_number"] == 30_000
    assert sorted(importing.read_dataset(store, id).select("n").toPandas()["n"]) == list(range(30_000))
    got = {r["var_name"]: r for r in store.read("dataset_summary", dataset_id=id).collect()}
    want = {r["var_name"]: r for r in profile(whole).collect()}
    assert got.keys() == want.keys()
    for name, w in want.items():
        g = got[name]
        for c in ("var_id", "var_type", "ds_count", "ds_min", "ds_max"):
            assert g[c] == w[c]
        assert g["ds_unique"] == pytest.approx(w["ds_unique"], rel=0.03)
        for c in ("ds_mean", "ds_std"):
            assert g[c] == (w[c] if w[c] is None else pytest.approx(w[c], rel=1e-9))
    x = np.sort([r[1] for r in rows if r[1] is not None])
    for c, p in (("ds_25", 0.25), ("ds_50", 0.5), ("ds_75", 0.75)):
        assert abs(np.searchsorted(x, got["x"][c]) / len(x) - p) < 0.005
    assert got["s"]["ds_50"] is None
    assert {r["variable"] for r in importing.dataset_variables(store, id).collect()} == {"n", "x", "s"}


def test_only_the_new_file_is_read(spark, make, store):
    id, _, _ = appended(spark, make, store, range(30), 2)
    assert all("/dataset_sketch/" in f or "/dataset_summary/" in f or "/dataset_part/" in f or "/dataset_deleted/" in f
               for f in store.read("dataset_summary", dataset_id=id).inputFiles())


@pytest.mark.parametrize("rows,schema", [
    ([(1, 2.0)], "n int, x double"),
    ([(1, 2.0, "a", 1)], "n int, x double, s string, more int"),
    ([("1.5", 2.0, "a")], "n string, x double, s string"),
    ([("99999999999", 2.0, "a")], "n string, x double, s string"),
    ([(1, "two", "a")], "n int, x string, s string"),
])
def test_what_does_not_fit_is_refused(spark, make, store, rows, schema):
    id, _, _ = appended(spark, make, store, range(30), 1)
    src = write_table(make(rows, schema), scratch_path(spark, "src"), "csv")
    with pytest.raises(ValueError):
        importing.append_to_dataset(store, id, src)
    assert store.get("dataset", id)["row_number"] == 30 and importing.read_dataset(store, id).count() == 30
    assert store.read("dataset_summary", dataset_id=id).filter("var_name = 'n'").first()["ds_count"] == 30


def test_other_order_no_values_and_parquet(spark, make, store):
    id, _, _ = appended(spark, make, store, range(30), 1)
    src = write_table(make([("007", None, 31)], "s string, x double, n int"), scratch_path(spark, "src"), "csv")
    importing.append_to_dataset(store, id, src)
    src = write_table(make([(2**20, 1.5, "z")], "n int, x float, s string"), scratch_path(spark, "src"))
    importing.append_to_dataset(store, id, src, "parquet")
    src = write_table(make([], "n int, x double, s string"), scratch_path(spark, "src"))
    importing.append_to_dataset(store, id, src, "parquet")
    found = importing.read_dataset(store, id).filter("s in ('007', 'z')").orderBy("n").collect()
    assert [tuple(r) for r in found] == [(31, None, "007"), (2**20, 1.5, "z")]
    assert store.get("dataset", id)["row_number"] == 32
    big = write_table(make([(2**40, 1.5, "z")], "n bigint, x double, s string"), scratch_path(spark, "src"))
    with pytest.raises(ValueError):
        importing.append_to_dataset(store, id, big, "parquet")


def test_parts_appended_at_once_all_count(spark, make, store):
    id, _, _ = appended(spark, make, store, range(30), 1)
    srcs = [write_table(make([(100 + i, 1.0, "a")], "n int, x double, s string"), scratch_path(spark, "src"), "csv") for i in range(4)]
    threads = [threading.Thread(target=importing.append_to_dataset, args=(store, id, src)) for src in srcs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.get("dataset", id)["row_number"] == 34 and importing.read_dataset(store, id).count() == 34
    assert store.read("dataset_part", dataset_id=id).select("id").distinct().count() == 4
    assert store.read("dataset_summary", dataset_id=id).filter("var_name = 'n'").first()["ds_max"] == 103
    store.delete_dataset(id)
    assert store.read("dataset_summary").count() == 0


def test_a_dataset_without_sketches_takes_no_parts(spark, make, store):
    src = write_table(make([(1, 2.0)], "n int, x double"), scratch_path(spark, "src"), "csv")
    id = importing.import_dataset(spark, src, "fixed", store, appendable=False)
    with pytest.raises(ValueError):
        importing.append_to_dataset(store, id, src)
