"""Every stage does to its input what its operator says, and run() does them one after the other."""
import collections
import hashlib

import corpus_pipeline as P
import sentencepiece
from modelscout.llm import mixing, pieces, quality
from modelscout.sources import materialize
from test_jaccard_join import brute as near
from test_mixing import brute as mixed

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        held[name] = len(rows)
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and all(after[i] == before[i] for i in after)
        if name == "quality classifier":
            scores = quality.quality_scores(spark.createDataFrame(list(before.values())), labels).collect()
            assert set(after) == {r["doc_id"] for r in scores if r["predicted"] == 1}
        elif name == "exact dedup":
            last = {}
            for i, r in sorted(before.items()):
                last[r["text"]] = i
            assert set(after) == set(last.values())
        elif name == "n-gram Jaccard join":
            classes = near([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {c for c, _ in classes.values()}
        elif name == "mixing sources to target weights":
            want = mixed([(i, r["text"], r["lang"], r["source"]) for i, r in before.items()], P.MIX_SHARE, 1)
            assert set(after) == {w[0] for w in want if w[-1]}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert {i: r["ids"] for i, r in after.items()} == {i: library.encode(r["text"]) for i, r in before.items()}
    counts = list(held.values())
    assert counts == sorted(counts, reverse=True) and collections.Counter(counts).most_common(1)[0][1] <= 2
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "n_pieces").collect())) == sorted((i, r["n_pieces"]) for i, r in after.items())
    assert mixing.WEIGHTS["domain"]


def test_last_stage_decodes_what_it_encodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r["decoded_sha256"] for r in P.pieces_stage(spark, docs, SF).collect()}
    assert got == {i: hashlib.sha256(library.decode(library.encode(t)).encode()).hexdigest() for i, t in texts.items()}


def test_edge_rows_and_clashing_columns(spark, make, tmp_path):
    """NULL, empty, blank, giant and repeated texts, NULL and repeated ids, and columns that are called as the stages' own."""
    giant = "The cat sat on the mat, and the dog ran after it. " * 4000
    good = [(i, f"This is a plain sentence number {i} about the weather. Another one follows it here.") for i in range(40)]
    bad = [(100 + i, f"BUY!!! $$$ {i} {i} | | | NOW NOW") for i in range(40)]
    rows = [*good, *bad, (200, None), (201, ""), (202, " \n"), (203, giant), (204, giant), (205, giant + "end"), (None, good[0][1]), (None, "a text of its own that nobody else has"),
            (206, good[1][1]), (206, good[1][1]), (206, "The same id with another text that is long enough to be good.")]
    names = ["own_sha", "sha", "keep", "gone", "gone_sha", "gone_row", "own_lang", "own_source", "copy", "plan_lang", "PLAN_FULL", "label", "x", "row", "digest", "score", "size", "class"]
    docs = make([(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 20}", k, *["x"] * len(names)) for k, (i, t) in enumerate(rows)],
                "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    make([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, library = docs.columns, sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    for name, stage in P.STAGES:
        before = collections.Counter(key(r) for r in docs.collect())
        texts = collections.Counter(r["text"] for r in docs.collect())
        docs = stage(spark, docs, str(tmp_path))
        if name == P.STAGES[-1][0]:
            got = sorted((str(r["doc_id"]), r["n_pieces"]) for r in docs.collect())
            assert got == sorted((i, len(library.encode("" if t == "None" else t))) for (i, t), n in before.items() for _ in range(n))
            continue
        docs = materialize(docs, "test")
        after = collections.Counter(key(r) for r in docs.collect())
        assert docs.columns == columns and not after - before
        if name == "quality classifier":
            assert all((str(i), t) in after for i, t in good) and not any((str(i), t) in after for i, t in bad)
        elif name == "exact dedup":
            assert {t for _, t in after} == {str(t or "") if t is not None else "None" for t in texts} or len({t for _, t in after} - {"None", ""}) == len({t for t in texts} - {None, ""})
            assert ("206", good[1][1]) in after and ("1", good[1][1]) not in after and (str(None), "a text of its own that nobody else has") in after
        elif name == "n-gram Jaccard join":
            assert ("204", giant) in after and ("205", giant + "end") not in after
            assert not {k for k in before - after if "sentence number" not in k[1] and k[0] != "205"}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
