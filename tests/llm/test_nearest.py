import numpy as np

from modelscout.llm import nearest as N

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=5):
    out = {}
    for i in queries:
        at = ids.index(i)
        score = N.cosines(x, x[at])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids = rows["vec_id"].tolist()
    want = brute(ids, N.matrix(rows["embedding"]), [i for i in ids if i % 50 == 0])
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    # lists as short, compared with the table, as on a large one
    got = by_query(N.nearest(frame, frame.filter("vec_id % 50 = 0"), rows_per_list=64).collect())
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    score = {q: dict(v) for q, v in got.items()}
    assert all(score[q].get(i, s) == s for q in want for i, s in want[q])


def test_exact_where_all_lists_are_probed(make):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).round(1)
    x[50:200] = x[50]  # a vector that half of the rows share
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(x)]
    bad = [(300, None), (301, [0.0] * 8), (302, [1.0] * 7), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] * 8), (None, [1.0] * 8)]
    frame = make(rows + [(i, v, 1, "b") for i, v in bad] + [rows[50]], "vec_id bigint, embedding array<double>, list int, v string")
    got = by_query(N.nearest(frame, frame.filter("vec_id % 5 = 0 OR vec_id IS NULL")).collect())
    assert got == brute(list(range(300)), x + 0.0, range(0, 300, 5))


def test_few_rows_and_large_numbers(make):
    schema = "vec_id bigint, embedding array<double>"
    frame = make([(0, [1e300, 1e300]), (50, [1e-300, 1e-300]), (7, [1e300, 0.0])], schema)
    got = by_query(N.nearest(frame, frame).collect())
    assert [i for i, _ in got[0]] == [50, 7] and [i for i, _ in got[7]] == [0, 50] and abs(got[0][0][1] - 1) < 1e-12
    one = make([(0, [1.0, 2.0])], schema)
    assert N.nearest(one, one).collect() == []
    assert N.nearest(one.limit(0), one.limit(0)).collect() == []


def test_scan_abandons_most_candidates_and_keeps_the_nearest():
    rng = np.random.default_rng(3)
    x = N.unit(rng.standard_normal((5000, 64))).astype(np.float32)
    turn = N.rotation(64, 1)
    q = N.unit(x[17][None] + 0.02 * rng.standard_normal((1, 64)))[0].astype(np.float32)
    kept = N.scan(x, np.split(x @ turn, 4, axis=1), q @ turn, 6)
    nearest = np.argsort(((x - q) ** 2).sum(axis=1))[:6]
    assert len(kept) < 20 and len(set(kept) & set(nearest)) >= 5
