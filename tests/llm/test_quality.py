"""The classifier against plain Python statistics, numpy covariances and the density written out."""
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from modelscout.llm import quality as Q

SF = "/root/testdata/sf0.01"
LONG = "Lorem ipsum | dolor 12!\n" * 20_000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    """FEATURES of one text, counted one character, word and line at a time."""
    text = text or ""
    words = SPLIT.findall(text)
    if not words:
        return [0.0] * len(Q.FEATURES)
    solid = sum(len(w.encode()) for w in words)
    some, letters = solid + 20.0, sum(c.isascii() and c.isalpha() for c in text) + 20.0
    share = lambda chars: sum(c in chars for c in text)
    lines = [tuple(SPLIT.findall(x)) for x in text.split("\n")]
    filled = [x for x in lines if x]
    # a line counts as another one's equal by the words it has, in any order
    doubled = len(filled) - len({tuple(sorted(x)) for x in filled})
    n = len(words)
    return [
        math.log1p(n), math.log1p(solid / n), math.sqrt(sum("A" <= c <= "Z" for c in text) / letters), math.sqrt(share("!?") / some),
        math.sqrt(share("#$%&*@^~=<>{}[]\\_`+") / some), math.sqrt(share("0123456789") / some), math.sqrt(share("|") / some),
        math.sqrt(sum(ord(c) > 127 for c in text) / some), math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n),
        math.log1p(len(set(words))) / max(math.log1p(n), 0.1), math.log1p(n / len(lines)), math.sqrt(doubled / len(filled)),
    ]


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "one", "ONE one!", "a a a a", "x\n\nx\nx y\ny x", "é日本 \U0001f600\x85", "| a | b |\n| a | b |", "\n", "1\r2\v3", LONG]
    for _ in range(80):
        out.append("".join(rng.choices("aB é1!|#\n\t ", k=rng.randrange(0, 400))))
    return out


def test_statistics_match_plain_python():
    got = Q.statistics(pa.array(texts()))
    for row, text in zip(got, texts()):
        assert row == pytest.approx(plain_statistics(text), abs=1e-12)
    # whatever slice of texts they are worked out in
    assert (got[5:9] == Q.statistics(pa.array(texts()[5:9]))).all()


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    d = len(Q.FEATURES)
    label = np.arange(n) % 3 == 0
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + 1.5 * label[:, None]
    x[label] *= rng.uniform(0.3, 2, d)
    return x, label.astype(int)


def plain_model(x, label, pooled=Q.POOLED, round_=Q.ROUND):
    """(share, mean, covariance) of both classes from numpy."""
    n = np.bincount(label)
    own = [np.cov(x[label == k].T, bias=True) for k in (0, 1)]
    common = sum(c * m for c, m in zip(own, n)) / n.sum()
    ridge = round_ * np.diag(np.diag(common))
    return [(n[k] / n.sum(), x[label == k].mean(axis=0), (1 - pooled) * own[k] + pooled * common + ridge) for k in (0, 1)]


def plain_scores(x, model, low, high):
    """Class 1's share of the two normal densities, written out."""
    x = np.clip(x, low, high)
    log = []
    for share, mean, cov in model:
        away = x - mean
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        log.append(math.log(share) - 0.5 * distance - 0.5 * np.linalg.slogdet(cov)[1])
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


@pytest.mark.parametrize("pooled,round_", [(Q.POOLED, Q.ROUND), (0.9, 0.5)])
def test_fit_and_scores_match_numpy(make, pooled, round_):
    x, label = sample(400)
    frame = make([(r.tolist(), int(k)) for r, k in zip(x, label)], "x array<double>, label int").repartition(5)
    model = Q.fit(frame, pooled, round_)
    want = plain_model(x, label, pooled, round_)
    for k in (0, 1):
        assert model.log_share[k] == pytest.approx(math.log(want[k][0])) and model.mean[k] == pytest.approx(want[k][1])
        assert np.linalg.inv(model.whiten[k].T @ model.whiten[k]) == pytest.approx(want[k][2], rel=1e-6, abs=1e-6)
    new, _ = sample(200, seed=1)
    new *= 3  # beyond what was seen
    assert model.score(new) == pytest.approx(plain_scores(new, want, x.min(axis=0), x.max(axis=0)), rel=1e-6, abs=1e-12)


def test_whole_path_matches_numpy(spark):
    """Statistics, labels and scores of the registered query, all worked out again from the table."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    learnt = [(plain_statistics(docs[i]), q) for i, q in labels if i in docs and fold(i) != 0]
    x, label = np.array([s for s, _ in learnt]), np.array([q for _, q in learnt])
    ids = sorted(docs)
    want = plain_scores(np.array([plain_statistics(docs[i]) for i in ids]), plain_model(x, label), x.min(axis=0), x.max(axis=0))
    got = {r["doc_id"]: r for r in Q.op5_quality(spark, SF).collect()}
    assert sorted(got) == ids
    assert [got[i]["score"] for i in ids] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-9)
    for i in ids:
        assert got[i]["held_out"] == (fold(i) == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = Q.op5_quality(spark, sf).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert len(bad) > 50
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.97


def labelled(n):
    good = [(i, f"This is a sentence about thing {i}. And here another one follows it.", 1) for i in range(0, 2 * n, 2)]
    return good + [(i, f"BUY!!! $$$ {i} {i} {i} | | | NOW NOW", 0) for i in range(1, 2 * n, 2)]


def test_edges(docs, make):
    """NULL, empty, blank, long and repeated texts, NULL and repeated ids, and columns that are called as the operator's."""
    known = labelled(30)
    rows = [(i, t) for i, t, _ in known]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, LONG), (1003, LONG), (1004, known[0][1]), (None, known[0][1]), (None, None), (1005, "BUY!!! NOW")]
    frame = docs(rows)
    frame = frame.selectExpr("doc_id", "text", "lang AS x", "source AS score", "n_chars AS label", "digest AS predicted", "kept AS held_out", "blob AS quality")
    marks = make([(i, q, i, "x") for i, _, q in known] + [(None, 1, 0, ""), (2, 0, 0, ""), (4, 7, 0, ""), (6, None, 0, ""), (9999, 1, 0, "")],
                 "doc_id bigint, quality int, x int, text string")
    got = Q.quality_scores(frame, marks).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    score = {}
    for r in got:
        score.setdefault(r["doc_id"], []).append(r["score"])
    empty = {score[i][0] for i in (1000, 1001, 1002)}
    assert len(empty) == 1 and score[1003][0] == score[1003][1] and score[1004][0] == score[0][0] and sorted(score[None]) == sorted([*empty, score[0][0]])
    kept = Q.good_documents(frame, marks)
    assert kept.columns == frame.columns
    want = sorted((str(r["doc_id"]), r["predicted"]) for r in got if r["predicted"])
    assert sorted((str(r["doc_id"]), 1) for r in kept.collect()) == want


def test_labels_of_one_class_or_none(docs, make):
    frame = docs([(1, "a"), (2, None), (3, "b c")])
    fold = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    for marks, share in (([], 0.5), ([(i, 1) for i in fold if i < 4], None), ([(i, 0) for i in fold if i < 4], None)):
        n = len(marks)
        share = 0.5 if share else ((n if marks[0][1] else 0) + 0.5) / (n + 1)
        got = Q.quality_scores(frame, make(marks, "doc_id bigint, quality int")).collect()
        assert [r["score"] for r in got] == pytest.approx([share] * 3)
        kept = Q.good_documents(frame, make(marks, "doc_id bigint, quality int")).count()
        assert kept == (3 if share >= 0.3 else 0)


def test_scores_do_not_depend_on_what_is_not_text(docs, make):
    known = labelled(30)
    marks = make([(i, q) for i, _, q in known], "doc_id bigint, quality int")
    frame = docs([(i, t) for i, t, _ in known])
    one = {r["doc_id"]: r["score"] for r in Q.quality_scores(frame, marks).collect()}
    other = frame.selectExpr("doc_id", "text", "'xx' AS lang", "concat('s', doc_id) AS source", "0 AS quality")
    assert {r["doc_id"]: r["score"] for r in Q.quality_scores(other, marks).collect()} == pytest.approx(one, rel=1e-9)


def test_empty_table(docs, make):
    marks = make([], "doc_id bigint, quality int")
    assert Q.quality_scores(docs([]), marks).collect() == [] and Q.good_documents(docs([]), marks).collect() == []
