import random
import re

import numpy as np
import pytest

from modelscout.llm import sketch_dedup as sd

LONG = "lorem ipsum dolor " * 4000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            same = len(sets[a] & sets[b])
            near = bool(sets[a]) and bool(sets[b]) and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same)
            # an id with several texts connects them, where they have words
            if near or rows[a][0] == rows[b][0] and sets[a] and sets[b]:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        component = None if i is None else low[find(k)]
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=str)


def corpus(seed, originals=12, copies=14, common=40):
    """Copies with a growing number of changed words, chains of them, short texts, and one pair of words in all texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    rows, next_id = [], iter(rng.sample(range(10_000), 2_000))
    for o in range(originals):
        base = [word() for _ in range(rng.choice([1, 2, 3, 6, 12, 25, 40, 200]))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 6) + 1)):
                text[rng.randrange(len(text))] = word()
            rows.append((next(next_id), " ".join(text).title() if c % 3 == 0 else "\n".join(text)))
            if c % 4 == 1:
                base = text
    rows += [(next(next_id), f"over there {' '.join(word() for _ in range(9))}") for _ in range(common)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4), (3, 3)])
def test_equals_all_pairs(docs, seed, block):
    rows = corpus(seed)
    got = sorted(map(tuple, sd.sketch_duplicates(docs(rows), block=block).collect()), key=str)
    assert got == brute(rows)


def test_hot_group_of_variants(docs):
    # a third of all rows are variants of one text, most of them too far from the leader of their lists
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(text)))
    rows += [(i, " ".join(f"u{rng.randrange(500)}" for _ in range(30))) for i in range(240)]
    for block in (16, 512):
        assert sorted(map(tuple, sd.sketch_duplicates(docs(rows), block=block).collect()), key=str) == brute(rows)


def test_edges(docs):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, LONG), (7, LONG + "end"), (7, "one"), (8, "a b"), (8, "a b"),
        (None, "a b"), (None, None), (9, "a b"), (-3, "A\tB"), (10, "\x85a b"), (11, "É b"), (12, "é b"),
    ]
    got = sorted(map(tuple, sd.sketch_duplicates(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(docs):
    assert sd.sketch_duplicates(docs([])).collect() == []


def test_least_shared():
    rng = np.random.default_rng(0)
    for kept in (8, 32, 64):
        least = sd.least_shared(kept, 80, 0.9999)
        assert (rng.binomial(kept, 0.8, 200_000) >= least).mean() >= 0.9998
        assert 0 < least < 0.8 * kept


def test_union_sketch():
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        a, b = (sorted(rng.sample(range(100), rng.randrange(1, 60)))[:16] for _ in "ab")
        pairs.append((a, b))
    a, b = (sd._padded([np.array(p[k], dtype=np.int64) for p in pairs], 16) for k in (0, 1))
    common, values = sd.union_matches(a, b, 16)
    for (x, y), c, v in zip(pairs, common, values):
        union = sorted({*x, *y})[:16]
        assert (c, v) == (sum(u in x and u in y for u in union), len(union))


def test_query_on_documents(spark):
    """The registered query on the smallest corpus, against all pairs."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op11_sketch_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
