import collections
import hashlib

import pandas as pd
from hypothesis import given, settings, strategies as st

from modelscout.llm import exact_dedup as E


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, "hot text") for i in range(40)] + [(i, f"text {i % 5}") for i in range(40, 60)] + [
    (70, None), (71, ""), (72, " "), (None, "hot text"), (None, "alone"), (45, "text 0"), (45, "text 0"), (80, "long " * 30_000), (81, "long " * 30_000), (82, "é😀"),
]


def test_all_counters(docs):
    frame = docs(ROWS).repartition(3)
    for counters in (1, 3, 1000):
        got = sorted((tuple(r) for r in E.exact_duplicates(frame, counters=counters).collect()), key=str)
        assert got == brute(ROWS)


def test_survivors(docs):
    frame = docs(ROWS)
    kept = E.without_duplicates(frame, counters=2)
    assert kept.columns == frame.columns
    want = [(i, t) for (i, t), r in zip(ROWS, ROWS) if i == max((x for x, y in ROWS if (y or "") == (t or "") and x is not None), default=None)]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)


def test_survivors_outside_the_frequent_texts(docs):
    """A row goes by its id and its text: not with another text of its id, nor with another row without an id."""
    rows = [(i, "hot text") for i in range(10)] + [(None, "copied"), (20, "copied"), (None, "alone"), (30, "A"), (31, "A"), (30, "B"), (None, "pair"), (None, "pair")]
    kept = E.without_duplicates(docs(rows).repartition(2), counters=1).select("doc_id", "text").collect()
    want = [(9, "hot text"), (20, "copied"), (None, "alone"), (31, "A"), (30, "B"), (None, "pair"), (None, "pair")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_empty(docs):
    assert E.exact_duplicates(docs([])).collect() == []
    assert E.without_duplicates(docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 5), st.integers(1, 7))
def test_summary_keeps_every_frequent_value(values, counters, parts):
    summaries = []
    for p in range(parts):
        s = pd.Series(dtype="int64")
        for k in range(p, len(values), parts * 3):
            s = E.reduce_counters(s.add(pd.Series(values[k : k + 1]).value_counts(), fill_value=0).astype("int64"), counters)
        summaries.append((s, len(range(p, len(values), parts * 3))))
    merged = pd.Series(dtype="int64")
    n = sum(x for _, x in summaries)
    seen = [v for p in range(parts) for v in values[p :: parts * 3]]
    for s, _ in summaries:
        merged = merged.add(s, fill_value=0)
    merged = E.reduce_counters(merged.astype("int64"), counters)
    for v, c in collections.Counter(seen).items():
        if c * (counters + 1) > n:
            assert v in merged.index
    assert len(merged) <= counters
