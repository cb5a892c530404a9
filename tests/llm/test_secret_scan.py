import hashlib
import re
import time

import duckdb
import numpy as np

from modelscout.llm import secret_scan as S

SF = "/root/testdata/sf0.01"
PATTERNS = [
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
]


def brute(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    found.sort()
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in xs)
    base = [x for x in found if x[1] < 3]
    count = [sum(x[1] == p for x in found) for p in range(3)]
    return (*count, hashlib.sha256(say(base).encode()).hexdigest(), say(found))


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in S.op4_secret_scan(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert got == {i: brute(t) for i, t in rows}
    assert sum(g[0] for g in got.values()) and sum(g[2] for g in got.values())


def test_edges(docs, tmp_path):
    texts = [
        None, "", "secret:token: value123", 'API_KEY = "abcdef"', "api_key='abc' token=abcdefg", "é😀 password=ünsafe passwd:abc123",
        "AKIAAKIA1234 AKIA" + "A1" * 9, "f" * 24 + "g" + "0" * 23, "f" * 100_000, "x AKIA" + "Z" * 16 + "\n" + "deadbeef" * 3,
        "-----BEGIN RSA PRIVATE KEY-----\nsecret=" + "a1b2c3d4" * 3, "token=abc token=abcdef", "paſſword=abcdefgh tokens=abcdefg",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (None, texts[3]), (3, texts[3])]
    frame = docs(rows)
    found = S.scan_documents(frame, str(tmp_path)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"], ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["found"])) for r in found if r["doc_id"] is not None)
    assert got == sorted((False, i, brute(t)[-1]) for i, t in rows if i is not None)
    assert len(found) == len(rows)


def test_running_sums(make):
    rows = [[], [5], [1, 2, 3], list(range(1, 101)), [7] * 1000]
    got = make([(k, r) for k, r in enumerate(rows)], "k int, v array<bigint>").orderBy("k").select(S.running_sums(S.F.col("v")).alias("s")).collect()
    assert [list(r["s"]) for r in got] == [np.cumsum(r).tolist() for r in rows]


def test_many_matches_in_one_text(docs, tmp_path):
    text = "é token=abcdef12\n" * 200_000
    start = time.perf_counter()
    (row,) = S.scan_documents(docs([(1, text)]), str(tmp_path)).select("found").collect()
    seconds = time.perf_counter() - start
    assert [(x["start"], x["end"]) for x in row["found"]] == [(17 * k + 2, 17 * k + 16) for k in range(200_000)]
    assert seconds < 60  # the square of the matches would take most of an hour


def test_only_unseen_pairs_are_scanned(docs, tmp_path):
    folder = str(tmp_path)
    first = docs([(1, "token=abcdef"), (2, "token=abcdef"), (3, None)])
    assert S.scan_new_blobs(first, folder) == 2
    assert S.scan_new_blobs(first, folder) == 0
    more = docs([(1, "token=abcdef"), (9, "secret=123456")])
    assert S.scan_new_blobs(more, folder) == 1
    newer = (*S.RULES[:-1], S.Rule("pem", 2, "-----BEGIN"))
    assert S.scan_new_blobs(more, folder, newer) == 2
    rows = S.scan_documents(first.unionByName(more), folder).collect()
    assert sorted((r["doc_id"], len(r["found"])) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 0), (9, 1)]


def test_empty_table(docs, tmp_path):
    assert S.scan_documents(docs([]), str(tmp_path)).collect() == []
