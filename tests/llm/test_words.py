import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from modelscout.llm import words as W

TEXT = st.one_of(st.none(), st.text("aAbé \t\n\x0b\x0c\r\x1c\x85 😀", max_size=60), st.text(max_size=30))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12), st.booleans(), st.integers(1, 6), st.integers(1, 40))
def test_numbers_stand_for_words(texts, lower, n, limit):
    array = pa.array(["skipped"] + texts, pa.string())[1:]
    data, bounds = W.bytes_of(array)
    got = []
    for a, b in W.slices(bounds, limit):
        part, cuts = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        begins, ends = W.spans(part, cuts)
        w, at = W.numbers(part, begins, ends, lower), np.searchsorted(begins, cuts)
        sh, sat = W.shingles(w, at, n)
        got += [(w[at[k] : at[k + 1]].tolist(), sh[sat[k] : sat[k + 1]].tolist()) for k in range(b - a)]
    names, grams = {}, {}
    assert len(got) == len(texts)
    for text, (numbers, runs) in zip(texts, got):
        want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if lower:
            want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in want]
        assert len(numbers) == len(want)
        for x, y in zip(numbers, want):
            assert names.setdefault(x, y) == y
        want_runs = [tuple(want[i : i + n]) for i in range(max(len(want) - n + 1, 1 if want else 0))]
        assert len(runs) == len(want_runs)
        for x, y in zip(runs, want_runs):
            assert grams.setdefault(x, y) == y
    assert len(set(names.values())) == len(names) and len(set(grams.values())) == len(grams)


def test_slices_bound_the_memory_of_long_batches():
    array = pa.array(["some words of a text " * 50] * 4000, pa.string())
    assert sum(b - a for a, b, _, _ in W.words(array)) == len(array)
    tracemalloc.start()
    try:
        for _ in W.words(array):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
