import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from modelscout.llm import alignment as al
from modelscout.llm.pieces import MODEL, load_model

A, B = load_model(al.BYTE_MODEL), load_model(MODEL)


@pytest.fixture(scope="module")
def library():
    """Both libraries, run plainly on whole texts, and the bytes of their tokens."""
    tool = Tokenizer.from_file(al.BYTE_MODEL)
    tool.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    for k, b in enumerate(x for x in range(256) if x not in printable):
        byte_of[chr(256 + k)] = b
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in json.loads(A)["model"]["vocab"].items() if t != "<|endoftext|>"}
    bytes_b = {}
    for i in range(pieces.vocab_size()):
        piece = pieces.id_to_piece(i)
        bytes_b[i] = bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
    return tool, pieces, bytes_a, bytes_b


def brute(rows, library):
    """All columns by loops over the tokens of one text after the other."""
    tool, pieces, bytes_a, bytes_b = library
    found = []
    for _, text in rows:
        a, b, want = [], [], b" " + (text or "").encode()
        if text:
            a, b = tool.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
                a, b = [], []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        groups, at = [], [0, 0]
        for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            sides = []
            for side in (0, 1):
                ids = []
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= end:
                    ids.append(str(spans[side][at[side]][2]))
                    at[side] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    count = Counter(p for *_, links, _ in found for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (id, _), (n_a, n_b, n_groups, links, groups) in zip(rows, found):
        best = sum(count[p] == top[p[0]] for p in links)
        out.append((id, n_a, n_b, n_groups, len(links), best, sum(count[p] for p in links), groups))
    return sorted(out, key=str), count, top


def texts():
    rng = random.Random(4)
    out = [
        None, "", " ", "  ", "a", "hello world", " hello  world ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁", "a▁b", "日本語のテキスト",
        "\U0001f600\U0001f601 mixed é́", "tabs\tand\nlines\r\n\n  x", "it's we'll don't I'VE", "1234567 89", "\x00\x01", "x" * 300, "﻿mark",
    ]
    words = "the of and Straße año naïve 12 ... été -- it's \U0001f600 foo_bar".split()
    for _ in range(60):
        out.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randrange(1, 60))))
    return [*out, "hello world", "hello world", None]


@pytest.mark.parametrize("slice_bytes", [1, 700, al.SLICE_BYTES])
def test_equals_loops_over_tokens(docs, library, slice_bytes):
    rows = [*enumerate(texts()), (None, "hello world"), (3, "a"), (None, None)]
    got = sorted(map(tuple, al.align_documents(docs(rows), A, B, slice_bytes=slice_bytes).collect()), key=str)
    want, count, top = brute(rows, library)
    assert got == want
    if slice_bytes == 700:
        pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in al.pair_counts(docs(rows), A, B, slice_bytes=700).collect()}
        assert pairs == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_empty_table(docs):
    assert al.align_documents(docs([]), A, B).collect() == []
    assert al.align_documents(docs([(1, None)]), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_parts_of_giant_texts_and_long_runs(library):
    rng = random.Random(9)
    aligner = al.Aligner(A, B)
    prose = " ".join("".join(rng.choices("abcdefé.,\n ", k=rng.randrange(1, 12))) for _ in range(60_000))
    for text in (prose, "word " * 60_000, "x" * 50_000, " " * 30_000 + "a", "\n" * 30_000, "ab1é" * 20_000, "日本" * 20_000):
        (a,), (b,) = aligner.encode([text])
        assert a.tolist() == library[0].encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == library[1].encode(text)
    assert len(aligner.parts(" " + prose)) > 3


def test_query_on_documents(spark, library):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, al.op13_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows, library)[0]]
    assert got == sorted(want, key=str)
