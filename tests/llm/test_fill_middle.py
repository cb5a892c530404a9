import hashlib
import random
import re

import numpy as np
import pytest

from modelscout.llm import fill_middle as fm

LONG = "lorem ipsum dolor\n" * 40_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(id, text, seed=7, rate=100, spm=50):
    """(doc_id, n, form, prefix_chars, middle_chars, output) one text at a time."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if id is None else id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(11)
    out = [None, "", "\n", "\n\n\n", "one line", "a\n", "a\nb", "<", "<\n<\n<", "P>\nS>\nM>", "a<P>\nb", "x\n<S>", "<M>", "é\n日本\n\U0001f600\n", "\r\n\x85\n", LONG]
    for _ in range(150):
        lines = ["".join(rng.choices("ab <>PSMé日\U0001f600\r", k=rng.choice([0, 3, 30, 3000]))) for _ in range(rng.randrange(0, 40))]
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 10}])
def test_equals_one_by_one(docs, options):
    rows = list(enumerate(texts(), -3))
    rows += [(5, "a\nb\nc"), (5, "a\nb\nc"), (5, "other\ntext"), (None, "a\nb\nc\nd"), (None, None)]
    made = fm.fill_in_middle(docs(rows), **options)
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted((brute(i, t, **options) for i, t in rows), key=str)
    back = sorted((r[0] for r in made.select(fm.restored(made["output"], made["form"])).collect()))
    assert back == sorted(t or "" for _, t in rows)


def test_empty_table(docs):
    assert fm.fill_in_middle(docs([])).collect() == []


@pytest.mark.parametrize("error", [3, 50, 1024])
def test_segments_miss_no_boundary_by_more_than_the_bound(error):
    rng = np.random.default_rng(1)
    for sizes in (np.zeros(0, int), rng.integers(1, 80, 1), rng.integers(1, 80, 20_000), np.full(300_000, 7), rng.pareto(0.6, 5_000).astype(int) + 1):
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        segments = np.array(fm.fit_segments(offsets, error))
        missed = offsets - fm.predict(segments, np.arange(len(offsets)))
        assert np.abs(missed).max() <= error
        assert segments[0, 0] == 0 and (np.diff(segments[:, 0]) > 0).all()
    assert len(fm.fit_segments(np.arange(300_000) * 7, error)) <= 300_000 // fm.LONGEST + 1


def test_index_has_few_segments_and_exact_cuts(docs):
    row = fm.line_index(docs([(1, LONG), (2, None)])).orderBy("doc_id").collect()
    assert row[0]["n"] == 40_000 and len(row[0]["segments"]) == 1 and len(row[0]["residuals"]) == 40_001
    assert (row[1]["n"], len(row[1]["segments"]), list(row[1]["residuals"])) == (0, 1, [0])


def test_query_on_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    want = []
    for r in spark.read.parquet(path).select("doc_id", "text").collect():
        *head, output = brute(r["doc_id"], r["text"])
        want.append((*head, sha(output), sha(r["text"] or "")))
    assert sorted(map(tuple, fm.op12_fill_middle(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
