import numpy as np
import pytest
from pyspark.sql import functions as F

from modelscout.operators import prep
from modelscout.plans import derived, preparing


def test_selection_leaves_lists_alone(make):
    df = make([], "Survived int, Sex string, Name string, Ticket string, Age double")
    categories, unused = ["Sex", "Name", "Survived"], ["Name", "Ticket"]
    chosen = prep.select_features(df, "Survived", categories, unused)
    assert chosen.features == ["Sex", "Age"] and chosen.categories == ["Sex"]
    assert chosen.df.columns == ["Survived", "Sex", "Age"]
    assert categories == ["Sex", "Name", "Survived"] and unused == ["Name", "Ticket"]


def test_movie_table(make):
    titles = make(
        [
            ("A", "a", 0, "2012", "90", "Drama,Comedy"),
            ("B", "b", 0, "2009", "80", "Drama"),
            ("C", "c", 0, "\\N", "70", "Drama"),
            ("D", "d", 0, "2022", "60", "\\N"),
            ("E", "e", 0, "2015", "50", "Action"),
            ("F", "f", 0, "2010", "50", "War"),
        ],
        "tconst string, primaryTitle string, isAdult int, startYear string, runtimeMinutes string, genres string",
    )
    ratings = make([("A", 9.0, 100), ("B", 5.0, 10), ("F", 4.0, 400)], "tconst string, averageRating double, numVotes int")
    rows = derived.movie_flags(titles, ratings).orderBy("tconst", "genres").collect()
    got = [(r["tconst"], r["genres"], r["rateHighLow"], r["voteHighLow"], r["rateGreaterThan8"]) for r in rows]
    # weighted mean rating (900 + 900 + 1600) / 600, mean votes 200
    assert got == [("A", "Comedy", 1, 0, 1), ("A", "Drama", 1, 0, 1), ("F", "War", 0, 1, 0)]


def test_flag_keeps_gaps(make):
    df = make([(1.0,), (3.0,), (None,)], "x double")
    assert [r["f"] for r in prep.flag_at_least(df, "x", prep.Mean("x"), "f").collect()] == [0, 1, None]


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(5000)
    train, test = prep.split(df, ["id"])
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 5000 and 3800 < len(a) < 4200
    again, _ = prep.split(df.repartition(7), ["id"])
    assert {r[0] for r in again.collect()} == a
    assert {r[0] for r in prep.split(df, ["id"], seed=1)[0].collect()} != a


def test_split_without_key_keeps_copies_together(make):
    df = make([(i % 50, None if i % 3 else "x") for i in range(1000)], "a int, b string")
    train, test = prep.split(df)
    assert not set(train.collect()) & set(test.collect())


def test_one_hot(make):
    df = make([("b", 1), ("a", 2), (None, 3), ("c", 4)], "k string, v int")
    out = prep.one_hot(df, ["k"])
    assert out.columns == ["v", "k_b", "k_c"]
    assert [tuple(r) for r in out.orderBy("v").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert prep.one_hot(df, ["k"], drop_first=False).columns == ["v", "k_a", "k_b", "k_c"]
    unseen = prep.one_hot(make([("z", 9)], "k string, v int"), ["k"], levels_of={"k": ["a", "b"]})
    assert tuple(unseen.first()) == (9, 0)
    with pytest.raises(ValueError, match="more than 2 levels"):
        prep.one_hot(df, ["k"], max_levels=2)


def test_numeric_levels_sort_as_numbers(make):
    df = make([(10, 0.5), (2, float("nan")), (None, -1.0), (9, 0.5)], "k int, x double")
    assert prep.levels(df, ["k", "x"]) == {"k": ["2", "9", "10"], "x": ["-1.0", "0.5"]}
    assert prep.one_hot(df, ["k"]).columns == ["x", "k_9", "k_10"]


def test_explode_keeps_missing_rows(make):
    df = make([(1, "a|b"), (2, None), (3, "c")], "id int, t string")
    got = {tuple(r) for r in prep.explode_delimited(df, "t", "|").collect()}
    assert got == {(1, "a"), (1, "b"), (2, None), (3, "c")}


def test_one_hot_aligned(make):
    train = make([("a",), ("b",), ("c",)], "k string")
    test = make([("b",), ("c",), ("d",)], "k string")
    a, b = prep.one_hot_aligned(train, test, ["k"])
    assert a.columns == b.columns == ["k_c"]


def test_sparse_dummies_drop_the_first_level(make):
    train = make([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    test = make([("z", 1), (None, 2), ("c", 3), ("a", 4)], "k string, v int")
    a, b = prep.one_hot_sparse(train, test, col="k", out="o")
    assert [r["o"].toArray().tolist() for r in a.orderBy("v").collect()] == [[0, 1], [0, 0], [1, 0]]
    assert [r["o"].toArray().tolist() for r in b.orderBy("v").collect()] == [[0, 0], [0, 0], [1, 0], [0, 0]]


def test_assemble_rejects_gaps(make):
    with pytest.raises(Exception):
        prep.assemble(make([(None,)], "x double"), ["x"]).collect()


def passengers(make):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        sex = "female" if rng.random() < 0.4 else "male"
        rows.append(
            (i, int(rng.random() < (0.8 if sex == "female" else 0.2)), sex, "SCQ"[rng.integers(3)] if i % 50 else None,
             f"name {i}", float(rng.integers(1, 80)) if i % 5 else None, float(rng.integers(5, 100)) if i % 7 else None)
        )
    return make(rows, "PassengerId int, Survived int, Sex string, Embarked string, Name string, Age double, Fare double")


def test_prepared_frames_are_numeric_and_whole(make):
    p = preparing.prepare(
        passengers(make), "Survived", ["Embarked", "Sex", "Name"], ["Name", "PassengerId"], keys=["PassengerId"]
    )
    assert p.features == ["Sex", "Embarked", "Age", "Fare"]
    assert p.columns == ["Age", "Fare", "Embarked_Q", "Embarked_S", "Sex_male"]
    for side in (p.train, p.test):
        assert {t for _, t in side.dtypes} <= {"int", "double"}
        assert side.dropna().count() == side.count()
    assert p.train.count() + p.test.count() == 300


def test_text_target_becomes_a_label_in_sort_order(make):
    df = make([(float(i), "yes" if i % 3 else "no", "k") for i in range(60)], "x double, t string, c string")
    p = preparing.prepare(df, "t", ["t", "c"])
    assert p.columns == ["x"] and p.features == ["x", "c"]
    both = p.train.unionByName(p.test)
    assert both.agg(F.sum("label")).first()[0] == 40


def test_bad_targets(make):
    with pytest.raises(ValueError):
        preparing.prepare(make([(1, 1.0), (2, 1.0), (3, 1.0)], "t int, x double"), "t")
    with pytest.raises(ValueError):
        preparing.prepare(make([(1, 1.0), (0, 1.0), (None, 1.0)], "t int, x double"), "t")


def test_aligned_levels_option(make):
    p = preparing.prepare(passengers(make), "Survived", ["Sex"], ["Name", "Embarked"], keys=["PassengerId"], levels_from="aligned")
    assert "Sex_male" in p.columns


@pytest.mark.parametrize("rows_a_task,tasks", [(1000, 3), (30, 8)])
def test_training_is_spread_by_its_rows(make, rows_a_task, tasks):
    """At least the tasks asked for, and none with more rows than it may have, whatever the size of the table."""
    df = make([(float(i), i % 2, i) for i in range(300)], "x double, t int, k int")
    p = preparing.prepare(df, "t", [], ["k"], keys=["k"])
    train, test = preparing.vectors(p, 3, rows_a_task)
    sizes = [len(part) for part in train.select("label").rdd.glom().collect()]
    assert len(sizes) == max(tasks, -(-sum(sizes) // rows_a_task)) and max(sizes) <= rows_a_task + len(sizes)
    assert sum(sizes) + test.count() == 300
