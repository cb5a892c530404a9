import collections
import random

import duckdb
import numpy as np
import pytest

from modelscout.llm import jaccard_join as J
from modelscout.llm.components import components

SF = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, similarity=0.8):
    """doc -> (class, links) for distinct ids."""
    by_gram = collections.defaultdict(list)
    sets = {i: grams(t) for i, t in rows}
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    common = collections.Counter()
    for ids in by_gram.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for (a, b), c in common.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_query_matches_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.op3_ngram_jaccard(spark, SF).collect()}
    assert got == brute(rows)
    assert any(n for _, n in got.values())


def edited(words, rng, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("block", [4, 1000])
def test_large_groups_and_edges(docs, block):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(3)]
    rows = [(i, edited(base[i % 3], rng, 0.02)) for i in range(60)]
    rows += [(i, "the same text in many copies here") for i in range(100, 140)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "two words"), (205, "  two\twords\n"), (206, "long " * 9000), (207, "long " * 9001)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(docs(rows), block=block, recall=0.99999).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (1, "x y z u v w"), (None, "a b c d e f"), (3, "else where")]
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in J.jaccard_join(docs(rows)).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 3, 0), ("None", None, 0)]
    kept = J.without_similar(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "1", "3", "None"]
    assert J.jaccard_join(docs([])).collect() == []


def test_rows_of_one_id_go_by_their_own_text(docs):
    """An id with two texts stays with the text of which it is the smallest id, and does not connect the two."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(3, " ".join([*a[:-1], "end"])), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b[:-1], "end"])), (8, None), (None, " ".join(a))]
    kept = J.without_similar(docs(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_groups_stay_bounded_in_a_large_bucket(docs, monkeypatch):
    """Copies of a bucket's rows for its many units count when units are dealt to groups."""
    seen = {}
    monkeypatch.setattr(J, "materialize", lambda df, label, f=J.materialize: seen.setdefault(label, f(df, label)))
    monkeypatch.setattr(J, "GROUP_ROWS", 256)
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(120)]
    found = J.jaccard_join(docs(rows), block=4).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 119)}
    sizes = [r["count"] for r in seen["jaccard-units"].groupBy("group").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 256, (len(sizes), sum(sizes), max(sizes))


def test_bands_reach_the_recall():
    bands, rows = J.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= J.MAX_HASHES
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        all_ = J.mix(rng.integers(0, 2**62, 90).astype(np.uint64))
        a, b = np.sort(all_[:85]), np.sort(np.concatenate([all_[:76], all_[85:]]))
        sig = J._signature(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, rows)
        hits += (sig[0] == sig[1]).any()
    assert hits >= 298


def test_components(spark, make):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(40)] + [(2000, 2000 + k) for k in range(100)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(make(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
