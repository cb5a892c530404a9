import hashlib
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from modelscout.llm import substring_dedup as D

SF = "/root/testdata/sf0.01"


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = {}
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                low[k] = min(low.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and low[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    got = sorted((tuple(r) for r in D.op6_substring_dedup(spark, SF).collect()), key=str)
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50)), key=str)
    assert got == want and sum(r[2] for r in got) > 0


def passages(rng, n_docs):
    pool = [[f"p{k}_{j}" for j in range(rng.randrange(3, 40))] for k in range(6)]
    rows = []
    for i in range(n_docs):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 8))] if rng.random() < 0.5 else rng.choice(pool)[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(w)))
    return rows


def test_shards_hot_anchors_and_edges(docs):
    rng = random.Random(4)
    rows = passages(rng, 150)
    rows += [(200, None), (201, ""), (202, "é" * 5), (203, "a " * 3000), (204, "a " * 2999), (205, " ".join("abcdefgh" * 3)), (206, " ".join("abcdefgh" * 2) + " x")]
    rows += [(None, rows[3][1]), (None, " ".join("abcdefgh" * 3)), (7, " ".join("abcdefgh" * 3)), (7, rows[8][1]), (8, rows[8][1])]
    for shard, hot in ((100_000, 4096), (60, 4096), (500, 1)):
        got = D.remove_repeated_passages(docs(rows), window=8, gram=3, shard_words=shard, hot_contexts=hot).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, 8), (shard, hot)
    assert D.remove_repeated_passages(docs([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=6), st.lists(st.integers(0, 2), max_size=20))
def test_automaton(sequences, text):
    a = D.SuffixAutomaton()
    for s in sequences:
        a.add(s)
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)} | {()}
    want = [max(n for n in range(e + 2) if tuple(text[e + 1 - n : e + 1]) in subs) for e in range(len(text))]
    assert a.matches(text) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_least(keys, width):
    got = D.sliding_least(np.array(keys, dtype=np.uint64), width).tolist()
    assert got == [min(keys[i : i + width]) for i in range(len(keys))]
