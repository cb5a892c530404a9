import collections
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from modelscout.llm import maxent as M

SF = "/root/testdata/sf0.01"


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def brute(rows, learn):
    count = collections.Counter(w for i, t in rows if learn(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        ws = tokens(t)
        score = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, len(ws), sum(count[w] > 0 for w in ws), n, score))
    return sorted(out, key=str)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("sent", [0, 50, M.SENT_WORDS])
def test_base_matches_brute_force(docs, sent):
    rows = [(i, f"The cat {i % 7} SAT on w{i * i % 91} É the mat. " * (i % 4)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen words"), (103, "long " * 20_000), (None, "the the"), (5, "the cat")]
    got = M.language_model_scores(docs(rows), M.fold("doc_id") != 1, sent_words=sent).collect()
    want = brute(rows, lambda i: not held(i))
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] < 0
    assert len(got) == len(want)


def test_query(spark):
    got = {r["doc_id"]: r for r in M.op9_maxent(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    for i, n, known, total, score in brute(rows, lambda i: not held(i)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(i))
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_add_up():
    """Over all words that are known and one that is not, the model's probabilities of the next word sum to 1."""
    rng = np.random.default_rng(0)
    count = rng.integers(1, 200, 40)
    number = np.sort(M.mix(np.arange(40, dtype=np.uint64)))
    class_ = (np.arange(40) % (M.CLASSES - 1)).astype(np.int8)
    mass = np.bincount(class_, weights=count + 0.5, minlength=M.CLASSES)
    mass[-1] = 0.5
    vocab = M.Vocabulary(number, count, class_, int(count.sum()), 40, np.log10(mass), np.log(mass / mass.sum()))
    weights = rng.standard_normal((M.FEATURES * M.BUCKETS, M.CLASSES)).astype(np.float32)
    history = M.features(np.concatenate([number[:3], number[:1]]), np.array([0, 4]))[3:]
    log_class = M._class_scores(weights, vocab.log_share.astype(np.float32), history)[0]
    words = np.append(number, np.uint64(1))
    c, k = vocab.look_up(words)
    assert np.sum((c + 0.5) * np.exp(log_class[k]) / 10 ** vocab.log_mass[k]) == pytest.approx(1, abs=1e-5)


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    t = M.mix(rng.integers(0, 30, 4000).astype(np.uint64))
    t[1::2] = M.mix(t[::2])  # every second word follows from the one before
    f, target = M.features(t, np.array([0, len(t)])), (t % np.uint64(M.CLASSES)).astype(int)
    weights, seen = np.zeros((M.FEATURES * M.BUCKETS, M.CLASSES), np.float32), np.zeros(M.FEATURES * M.BUCKETS, np.float32)
    base = np.zeros(M.CLASSES, np.float32)
    loss = lambda: -M._class_scores(weights, base, f)[np.arange(len(t)), target].mean()
    first = loss()
    for _ in range(20):
        M.train_step(weights, seen, base, f, target, M.RATE)
    assert loss() < 0.8 * first


def plain_step(weights, seen, base, f, target, rate):
    """The gradient step as its definition goes, in the same order of additions."""
    z = base + weights[f[:, 0]]
    for k in range(1, f.shape[1]):
        z += weights[f[:, k]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    gradient = -np.exp(z)
    gradient[np.arange(len(f)), target] += 1
    for k in range(f.shape[1]):
        order = np.argsort(f[:, k], kind="stable")
        rows, starts, n = np.unique(f[order, k], return_index=True, return_counts=True)
        seen[rows] += n
        weights[rows] += (rate / f.shape[1]) * np.add.reduceat(gradient[order], starts) / np.sqrt(n * seen[rows])[:, None]


def test_step_is_the_plain_one_and_faster():
    rng = np.random.default_rng(6)
    t = M.mix(rng.zipf(1.2, 3 * M.STEP_TOKENS).astype(np.uint64) % np.uint64(50_000))
    buckets = M.buckets_for(10**8)
    f, target = M.features(t, np.array([0, len(t)]), buckets), (t % np.uint64(M.CLASSES)).astype(int)
    base = rng.standard_normal(M.CLASSES).astype(np.float32)
    took, tables = [], []
    for step in (plain_step, M.train_step):
        weights, seen = np.zeros((M.FEATURES * buckets, M.CLASSES), np.float32), np.zeros(M.FEATURES * buckets, np.float32)
        seconds = []
        for a in [*range(0, len(t), M.STEP_TOKENS), *range(100, len(t) - 9000, 9000)]:
            b = a + (M.STEP_TOKENS if a % M.STEP_TOKENS == 0 else 9000)
            start = time.process_time()
            step(weights, seen, base, f[a:b], target[a:b], M.RATE)
            seconds.append(time.process_time() - start)
        took.append(min(seconds[:3]))
        tables.append((weights, seen))
    assert all(np.array_equal(a, b) for a, b in zip(*tables))
    assert took[1] < 0.8 * took[0]


def test_look_up_finds_every_word():
    """Numbers spread evenly, close together, and at both ends."""
    rng = np.random.default_rng(7)
    ends = np.array([0, 1, 2**64 - 1], dtype=np.uint64)
    close = np.arange(5000, dtype=np.uint64) * np.uint64(3) + np.uint64(1 << 40)
    even = M.mix(np.arange(3000, dtype=np.uint64))
    for number in (even, close, np.concatenate([even, close, ends]), ends[:1], ends[2:], even[:2]):
        number = np.unique(number)
        count = np.arange(1, len(number) + 1)
        vocab = M.Vocabulary(number, count, (count % 15).astype(np.int8), 0, 0, None, None)
        w = rng.permutation(np.concatenate([even, close, close + np.uint64(1), even + np.uint64(1), ends]))
        at = {int(x): int(c) for x, c in zip(number, count)}
        want = np.array([at.get(int(x), 0) for x in w])
        c, k = vocab.look_up(w)
        assert np.array_equal(c, want) and np.array_equal(k, np.where(want > 0, want % 15, M.CLASSES - 1))


def test_table_grows_with_the_corpus(docs):
    """More tokens give more buckets, and contexts that a small table would mix up are learnt from each on its own."""
    sizes = [M.buckets_for(10**k) for k in range(5, 12)]
    assert sizes == sorted(sizes) and all(n % M.PLACE == 0 and n >= M.GROWTH * 10 ** (k / 2) for k, n in zip(range(5, 12), sizes))
    assert sizes[-1] > 9 * sizes[-3]
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 300, (300, 300))
    rows = []
    for i in range(200):
        w = [0, 1]
        while len(w) < 1000:
            w.append(int(follow[w[-2], w[-1]]) if rng.random() < 0.7 else int(rng.integers(0, 300)))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    frame = docs(rows).repartition(3)
    vocab = M.vocabulary(M.word_counts(frame))
    score = {}
    for growth in (M.GROWTH, 600.0):
        weights = M.train(frame, vocab, growth=growth)
        assert len(weights) == M.FEATURES * M.buckets_for(vocab.total, growth)
        score[len(weights)] = sum(r["score"] for r in M._scored(frame, vocab, weights).collect()) / vocab.total
    small, large = sorted(score)
    assert large >= 16 * small and score[large] > score[small] + 0.01


def test_tasks_are_averaged_by_what_they_met():
    rows = [M.pd.DataFrame(dict(zip(b.schema.names, (c.to_pylist() for c in b.columns)))) for b in [
        *M._send(np.array([3, M.PLACE + 1]), np.full((2, M.CLASSES), 2.0, np.float32), np.array([1, 4], np.float32), 0),
        *M._send(np.array([3, 5]), np.full((2, M.CLASSES), 6.0, np.float32), np.array([3, 2], np.float32), 0),
    ]]
    every = M.pd.concat(rows)
    at, moved, met = M._unpacked(*M._add((0,), every[every["place"] == 0]).iloc[0][["at", "moved", "scale", "met"]])
    assert list(at) == [3, 5] and list(met) == [4, 2] and moved == pytest.approx(np.repeat([[8.0], [6.0]], M.CLASSES, axis=1), rel=1e-6)
    assert sorted(every["place"]) == [0, 0, 1]


def test_eight_bits_miss_little():
    rng = np.random.default_rng(2)
    moved = rng.standard_normal((500, M.CLASSES)) * 10.0 ** rng.integers(-6, 6, (500, 1))
    moved[7] = 0
    at, back, met = M._unpacked(*M._packed(np.arange(500), moved, np.ones(500)))
    assert list(at) == list(range(500)) and (np.abs(back - moved).max(axis=1) <= np.abs(moved).max(axis=1) / 253).all() and (met == 1).all()


def test_score_matches_a_plain_model(docs):
    """The whole score, token by token in plain Python with the same weights."""
    rows = [(i, f"The cat {i % 7} sat on w{i * i % 23} the mat. " * (i % 5)) for i in range(50)] + [(90, None), (91, "one"), (92, "new words here")]
    frame = docs(rows).selectExpr("doc_id", "coalesce(text, '') AS text").repartition(3)
    vocab = M.vocabulary(M.word_counts(frame), 30)
    rng = np.random.default_rng(4)
    weights = (M.train(frame, vocab) + rng.standard_normal((M.FEATURES * M.BUCKETS, M.CLASSES))).astype(np.float16)
    top = 2**64

    def scramble(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % top
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) % top
        return x ^ x >> 31

    step = 0x9E3779B97F4A7C15
    count = collections.Counter(w for _, t in rows for w in tokens(t))
    number = {}
    for w in count:
        if w is not None:
            (_, _, n, _), = M.words(M.pa.array([w]), lower=True)
            number[w] = int(n[0])
    number[None] = int(M.END)
    class_of = dict(zip(vocab.number.tolist(), vocab.class_.tolist()))
    got = {r["doc_id"]: r for r in M._scored(frame, vocab, weights).collect()}
    for i, t in rows:
        ws, score, rare = [number[w] for w in tokens(t)], 0.0, 0.0
        for k, (w, name) in enumerate(zip(ws, tokens(t))):
            one, two, three = (ws[k - d] if k >= d else d for d in (1, 2, 3))
            kinds = (one, one + two * step, one + two * step + three * step * step, two)
            z = vocab.log_share.astype(float)
            for kind, x in enumerate(kinds):
                z = z + weights[(scramble(x % top ^ scramble(kind + 11)) >> 24) % M.BUCKETS + kind * M.BUCKETS].astype(float)
            z -= z.max()
            own = class_of.get(w, M.CLASSES - 1)
            score += (z[own] - math.log(np.exp(z).sum())) / math.log(10) - vocab.log_mass[own]
            if w in class_of:
                score += math.log10(count[name] + 0.5)
            else:
                rare += 1
        assert got[i]["score"] == pytest.approx(score, abs=1e-3, rel=1e-5) and len(got[i]["rare"]) == rare


def test_empty(docs):
    assert M.language_model_scores(docs([]), M.fold("doc_id") != 1).collect() == []
