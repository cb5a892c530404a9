import hashlib
import os
import random
import time
import tracemalloc

import duckdb
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from modelscout.llm import pieces as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def tool():
    return P.Pieces(P.load_model())


def in_chunks(tool, text, chunk):
    """The chunked encoding of one text, without Spark."""
    plain = tool.plain(text)
    n = -(-len(plain) // chunk)
    parts = []
    for k in range(n):
        last = k == n - 1
        enters = [0] if k == 0 else tool.states(plain, k * chunk)
        cut = len(plain) if last else (k + 1) * chunk
        leaves = [len(plain)] if last else tool.states(plain, cut)
        m = {(a, b): (w, f, e, ()) for a, b, w, f, e in tool.matrix(plain, enters, cut, leaves)}
        if last and len(plain) in enters:
            m[len(plain), len(plain)] = (0.0, "", "", ())
        parts.append(m)
    cuts = [0, *P._boundaries(max(tool.product(parts).values(), key=lambda v: v[0])[3]), len(plain)]
    return [i for a, b in zip(cuts, cuts[1:]) for i in tool.encode(plain[a:b])]


ALPHABET = st.one_of(st.text("abeinrst he", max_size=400), st.text("a b\n", max_size=300), st.text(max_size=120), st.text("th eé😀☃ \u0001", max_size=200))


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(20, 90))
def test_chunks_give_the_whole_encoding(tool, library, text, chunk):
    if text:
        assert in_chunks(tool, text, chunk) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_equals_the_library(tool, library, text, free):
    """Of encoded texts and of any ids."""
    rows = [library.encode(text), free, [], [29871], [29871, 29871, 263], [1, 263, 2], [0]]
    cuts = P.np.cumsum([0, *map(len, rows)])
    flat = P.np.array([i for r in rows for i in r], dtype=P.np.int64)
    assert tool.decode_all(flat, cuts) == [library.decode(r) for r in rows]


def test_long_without_blanks(tool, library):
    random.seed(1)
    for alphabet in ("a", "ab", "etaoinshr", "0123456789", "é", "☃", "aé☃b"):
        text = "".join(random.choices(alphabet, k=5000))
        assert in_chunks(tool, text, 700) == library.encode(text)


def test_product_is_associative(tool, library):
    text = "thequickbrownfoxjumpsoverthelazydog" * 12
    plain, chunk = tool.plain(text), 90
    n = -(-len(plain) // chunk)
    parts = []
    for k in range(n):
        last = k == n - 1
        enters = [0] if k == 0 else tool.states(plain, k * chunk)
        cut = len(plain) if last else (k + 1) * chunk
        leaves = [len(plain)] if last else tool.states(plain, cut)
        parts.append({(a, b): (w, f, e, ()) for a, b, w, f, e in tool.matrix(plain, enters, cut, leaves)})
    a, b, c = parts[:3]
    flat = lambda m: {at: (*v[:3], P._boundaries(v[3])) for at, v in m.items()}
    assert flat(tool.combine(tool.combine(a, b), c)) == flat(tool.combine(a, tool.combine(b, c)))
    assert len(next(iter(flat(tool.product(parts)).values()))[3]) == n - 1


def test_documents(docs, library):
    giant = "the cat sat on the mat. " * 60 + "ab" * 700
    rows = [(1, None), (2, ""), (3, " "), (4, "Hello  world\n\té😀"), (5, giant), (6, giant), (5, giant), (None, giant + "!"), (7, "x" * 1000), (8, "☃" * 1001), (9, "a" * 999)]
    encoded = P.encode_documents(docs(rows), P.load_model(), chunk=1000)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect())
    assert got == sorted((str(i), library.encode(t or "")) for i, t in rows)
    back = sorted((str(r["doc_id"]), r["decoded"]) for r in P.decode_ids(encoded, P.load_model()).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert P.encode_documents(docs([]), P.load_model()).collect() == []


@pytest.mark.parametrize("run", [1, 3, 64])
def test_runs_of_chunks(spark, library, run):
    """Texts of many chunks, whose matrices are combined in runs, and one that ends where its last chunk begins."""
    rng = random.Random(7)
    texts = ["".join(rng.choices(a, k=9000)) for a in ("ab e", "th eaoin", "é☃x")] + ["a" * 4999, "the " * 1250, "x" * 250 + " " * 700]
    giant = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "sha string, text string")
    got = {r["sha"]: r["ids"] for r in P.encode_giant(giant, P.load_model(), chunk=500, run=run).collect()}
    assert got == {str(k): library.encode(t) for k, t in enumerate(texts)}


def test_cutting_is_linear(spark):
    """Four times the text takes about four times as long, and not sixteen times."""
    seconds = []
    for n in (4, 16):
        text = spark.range(1).selectExpr("'x' AS sha", f"repeat('the cat sat on a mat and ', {n * 1_000_000 // 25}) AS text")
        start = time.perf_counter()
        cut = P.chunks_of(text, P.BLANK_PIECE, 16, P.CHUNK).selectExpr("count(*)", "sum(length(part))").first()
        seconds.append(time.perf_counter() - start)
        assert cut[0] == -(-(n * 1_000_000 // 25 * 25 + 1) // P.CHUNK)
    assert seconds[1] < 8 * seconds[0] + 2


def test_decoding_takes_little_more_than_the_text(tool, library):
    """Also of many ids in one row; looked up all at once, a byte takes some 30."""
    ids = P.np.array(library.encode("the cat sat on a mat and ") * 100_000, dtype=P.np.int64)
    tracemalloc.start()
    (text,) = tool.decode_all(ids, P.np.array([0, len(ids)]))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert text == library.decode(ids.tolist())
    assert most < 15 * len(text)


def test_no_task_encodes_and_decodes(docs, library):
    """Two Python workers a task took twice the memory."""
    rows = [(1, "Hello"), (2, None), (3, "the cat sat " * 4000)]
    got = P.round_trip(docs(rows))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: (r["ids"], r["n_pieces"]) for r in got.collect()} == {i: (library.encode(t or ""), len(library.encode(t or ""))) for i, t in rows}


def test_query(spark, library):
    got = {r["doc_id"]: r for r in P.op10_pieces(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["ids"] == library.encode(t) and got[i]["n_pieces"] == len(got[i]["ids"])
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
