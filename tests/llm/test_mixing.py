import collections
import hashlib
import math

from hypothesis import given, settings, strategies as st

from modelscout.llm import mixing as M


def fill(children, budget):
    """Shares by repeated dealing: [(name, capacity, weight)]."""
    share, open_ = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while open_:
        level = budget / sum(c[2] for c in open_)
        if level < open_[0][1] / open_[0][2]:
            return share | {c[0]: max(0, min(c[1], math.floor(level * c[2]))) for c in open_}
        share[open_[0][0]] = open_[0][1]
        budget -= open_[0][1]
        open_ = open_[1:]
    return share


def brute(rows, share, epochs, seed=17):
    docs = []
    for i, text, lang, source in rows:
        source = source or ""
        domain = next((d for d, s in M.DOMAINS.items() if source in s), M.OTHER_DOMAIN)
        docs.append((i, (domain, lang or "", source), len((text or "").split())))
    leaf = collections.Counter()
    for _, path, n in docs:
        leaf[path] += n
    budget = {(): math.floor(sum(leaf.values()) * share)}
    for depth, level in enumerate(M.LEAF):
        for parent in [p for p in budget if len(p) == depth]:
            cap = collections.Counter()
            for path, n in leaf.items():
                if path[:depth] == parent:
                    cap[path[depth]] += n * epochs
            for name, b in fill([(c, n, M.WEIGHTS[level].get(c, 1)) for c, n in cap.items()], budget[parent]).items():
                budget[(*parent, name)] = b
    out = []
    for i, path, n in docs:
        whole = budget[path] // leaf[path] if leaf[path] else epochs
        rest = budget[path] - whole * leaf[path]
        key = lambda j: hashlib.md5(f"{seed}|{whole}|{'' if j is None else j}".encode()).hexdigest()
        start = sum(m for j, p, m in docs if p == path and key(j) < key(i))
        out.append((i, *path, n, whole + (start < rest)))
    return sorted(out, key=str)


ROWS = [(i, "word " * (i % 7), ["en", "de", "xx", None][i % 4], ["src0", "src11", "src17", None, "other"][i % 5]) for i in range(120)]
ROWS += [(200, None, "en", "src0"), (201, "", None, None), (202, "long " * 5000, "fr", "src3"), (5, "again", "de", "src0"), (None, "no id", "en", "src0"), (300, None, "none", "src12")]


def frame(make, rows):
    return make([(i, t, g, s, "x", 1, "k") for i, t, g, s in rows], "doc_id bigint, text string, lang string, source string, domain string, share int, key string")


def test_matches_brute_force(make):
    for share, epochs in ((0.5, 2), (0.05, 1), (1.0, 1), (1.7, 2), (3.0, 2), (0.0, 1)):
        got = sorted((tuple(r) for r in M.mix(frame(make, ROWS), share, epochs).collect()), key=str)
        assert got == brute(ROWS, share, epochs), (share, epochs)


def test_chosen_documents(make):
    docs = frame(make, ROWS)
    got = M.mixed_documents(docs, 0.8, 2)
    assert got.columns == docs.columns
    want = [i for i, *_, copies in brute(ROWS, 0.8, 2) for _ in range(copies)]
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, want))


def test_shortage_goes_to_siblings_first(make):
    children = make([("a", "x", 10, 1.0, 100), ("a", "y", 100, 1.0, 100), ("a", "z", 100, 3.0, 100), ("b", "x", 5, 1.0, 9), ("b", "y", 1, 1.0, 9)], "p string, c string, capacity bigint, weight double, budget bigint")
    got = {(r["p"], r["c"]): r["share"] for r in M.water_fill(children, ["p"], "c").collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 22, ("a", "z"): 67, ("b", "x"): 5, ("b", "y"): 1}


def test_empty(make):
    assert M.mix(frame(make, [])).collect() == []
    assert M.mixed_documents(frame(make, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=8), st.integers(0, 300))
def test_dealing_spends_the_budget(children, budget):
    named = [(str(i), c, w) for i, (c, w) in enumerate(children)]
    got = fill(named, budget)
    assert all(got[n] <= c for n, c, _ in named)
    assert min(budget, sum(c for _, c, _ in named)) - len(named) <= sum(got.values()) <= budget
