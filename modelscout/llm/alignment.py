"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other.

Texts are shuffled whole, and each distinct text is tokenised and aligned once; its pairs of ids count as often as it has copies.
Texts are worked on in slices. A slice counts each of its pairs in one place of a list, sends that list to the corpus-wide count, and keeps,
text by text, only the places. So what is shuffled are the different pairs of a slice and not the tokens, and the counts come back to
a slice in the order of its list.

The byte-level tokenizer is run by its ranks, which are its ids, with the byte table of its family. A giant text is tokenised
in parts that begin at a blank between two ASCII letters or digits, where both tokenizers begin a token.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.llm.pieces import BLANK_PIECE, MODEL, load_model
from modelscout.llm.words import bytes_of, slices
from modelscout.sources.scratch import materialize

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PART = 1 << 16  # characters of a text that are tokenised at once
SLICE_BYTES = 1 << 24  # of texts that share a list of pairs
# Fixed value: how this family of byte-level tokenizers splits a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LONG_RUN = 4096  # characters of white space in a row, from which on the pattern is left to the vocabulary's own library
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_table() -> dict[str, int]:
    """The byte that every character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteTokens:
    """Ids of a byte-level vocabulary (a ``tokenizers`` file), with special tokens taken for plain text."""

    def __init__(self, model: bytes):
        import tiktoken

        parsed = json.loads(model)
        vocabulary, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        special = {t["id"] for t in parsed["added_tokens"] if t["special"]}
        vocabulary = {piece: i for piece, i in vocabulary.items() if i not in special}
        table = byte_table()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.tokens[i] = bytes(table[c] for c in piece)
        # ranks stand for merges only if ids follow their order
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(vocabulary):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {self.tokens[i]: i for i in vocabulary.values()}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model, self.slow = model, None

    def encode(self, part: str) -> np.ndarray:
        if RUN.search(part):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.model.decode())
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(part, add_special_tokens=False).ids, dtype=np.int64)
        return self.fast.encode_to_numpy(part, disallowed_special=()).astype(np.int64)


class PieceTokens:
    """Ids of a SentencePiece vocabulary for texts that have their blank at the front already."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a vocabulary is expected that puts a blank before the text")
        proto.normalizer_spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.tokens = [
            bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(BLANK_PIECE, " ").encode() for p in proto.pieces
        ]
        plain = [p.piece for p in proto.pieces if p.type not in (2, 3, 6)]
        self.cuttable = not any(BLANK_PIECE in p.lstrip(BLANK_PIECE) for p in plain)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.processor.encode(parts, num_threads=1)


@dataclass
class Aligned:
    """What the alignment of some texts yields, text by text."""

    counts: np.ndarray  # n_a, n_b, n_groups, n_links of every text
    groups: list[bytes]  # the groups as text
    owner: np.ndarray  # the text, the pair and the number of links of every different pair of a text
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers; a pair of ids is the number a * (ids of B) + b."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.width = len(self.b.tokens)
        self.tables = []
        for tokens, ends in ((self.a.tokens, ",|"), (self.b.tokens, ",;")):
            names = [np.array([f"{i}{end}".encode() for i in range(len(tokens))], dtype=object) for end in ends]
            self.tables.append((np.array(tokens, dtype=object), np.array([len(t) for t in tokens], dtype=np.int64), names))

    def parts(self, text: str) -> list[str]:
        """The text in parts that can be tokenised apart."""
        if len(text) <= PART or not self.b.cuttable:
            return [text]
        out, at = [], 0
        while cut := CUT.search(text, at + PART):
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of every text, with a blank before it."""
        split = [self.parts(" " + t) for t in texts]
        pieces = iter(self.b.encode([p for parts in split for p in parts]))
        a = [np.concatenate([self.a.encode(p) for p in parts]) for parts in split]
        b = [np.array([i for _ in parts for i in next(pieces)], dtype=np.int64) for parts in split]
        return a, b

    def align(self, texts: list[bytes]) -> Aligned:
        """Texts that are empty, or that either tokenizer does not give back, have no tokens."""
        n = len(texts)
        a, b = self.encode([t.decode() for t in texts])
        empty = np.zeros(0, dtype=np.int64)
        for k, text in enumerate(texts):
            if not text or any(b"".join(table[ids].tolist()) != b" " + text for (table, *_), ids in zip(self.tables, (a[k], b[k]))):
                a[k] = b[k] = empty
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b))
        ids_a, ids_b = (np.concatenate([empty, *ids]) for ids in (a, b))
        len_a, len_b = self.tables[0][1][ids_a], self.tables[1][1][ids_b]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)  # both give the same bytes, so one text's ends with the other's
        text_a = np.repeat(np.arange(n), n_a)

        met = np.zeros(len(end_a), dtype=bool)
        if len(end_a):
            met = end_b[np.searchsorted(end_b, end_a)] == end_a
        common = end_a[met]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)

        first = np.searchsorted(end_b, end_a - len_a, side="right")
        count = np.searchsorted(end_b - len_b, end_a, side="left") - first
        at_b = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        code = np.repeat(text_a * (len(self.a.tokens) * self.width) + ids_a * self.width, count) + ids_b[at_b]
        code, times = np.unique(code, return_counts=True)
        owner, pair = np.divmod(code, len(self.a.tokens) * self.width)
        counts = np.stack([n_a, n_b, np.bincount(text_a[met], minlength=n), np.bincount(text_a, weights=count, minlength=n).astype(np.int64)], axis=1)
        return Aligned(counts, self._written(ids_a, ids_b, group_a, group_b, n_a + n_b), owner, pair, times)

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The groups of every text: ids of A, a bar, ids of B, and a semicolon between groups."""
        out = np.empty(len(ids_a) + len(ids_b), dtype=object)
        places = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, side="left"), np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        for ids, group, place, (*_, names) in zip((ids_a, ids_b), (group_a, group_b), places, self.tables):
            last = np.append(group[1:] != group[:-1], True)[: len(ids)]
            out[place] = np.where(last, names[1][ids], names[0][ids])
        tokens, ends = out.tolist(), np.cumsum(sizes)
        return [b"".join(tokens[e - s : e])[:-1] for e, s in zip(ends, sizes)]


def _packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places in ascending order and numbers of links, compressed."""
    raw = np.concatenate([np.diff(places, prepend=0), times]).astype("<u4").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype="<u4").astype(np.int64)
    return np.cumsum(raw[:n]), raw[n:]


ROWS = (
    "slice string, sha string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_pairs int, places binary, "
    "pairs array<bigint>, weights array<bigint>"
)


def align_texts(texts: DataFrame, a: bytes, b: bytes, digest: bool, slice_bytes: int) -> DataFrame:
    """ROWS of distinct texts (sha, n_docs, text): one per text, and one per slice with its list of pairs and no ``sha``.

    A slice is named by its first text. ``weights`` are the documents that hold each pair of its list.
    """
    schema_names = [f.split()[0] for f in ROWS.split(", ")]

    def rows(aligner: Aligner, held: list) -> pa.RecordBatch:
        """The rows of a slice, from (shas, copies, aligned) of its batches."""
        shas = [s for h in held for s in h[0]]
        pairs, place = np.unique(np.concatenate([h[2].pair for h in held]), return_inverse=True)
        copies = np.concatenate([np.asarray(h[1], dtype=np.int64)[h[2].owner] for h in held])
        weights = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(weights, place, copies)
        times = np.concatenate([h[2].times for h in held])
        sizes = np.concatenate([np.bincount(h[2].owner, minlength=len(h[0])) for h in held])
        ends = np.cumsum(sizes)
        counts = np.concatenate([h[2].counts for h in held])
        packed = [_packed(place[e - s : e], times[e - s : e]) for e, s in zip(ends, sizes)]
        nulls = [None] * len(shas)
        columns = [
            [shas[0]] * (len(shas) + 1), [*shas, None], *([*counts[:, k].tolist(), None] for k in range(4)),
            [*(g for h in held for g in h[3]), None], [*sizes.tolist(), None], [*packed, None], [*nulls, pairs], [*nulls, weights],
        ]
        types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = None, [], 0
        for batch in batches:
            aligner = aligner or Aligner(a, b)
            data, bounds = bytes_of(batch.column(2))
            shas, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in slices(bounds, limit=1 << 20):
                aligned = aligner.align([data[x:y].tobytes() for x, y in zip(bounds[s:e], bounds[s + 1 : e + 1])])
                # without tokens there are no groups, and nothing to hash
                written = [(hashlib.sha256(g).hexdigest() if digest else g.decode()) if g else "" for g in aligned.groups]
                aligned.groups = []
                held.append((shas[s:e], copies[s:e], aligned, written))
                size += int(bounds[e] - bounds[s])
                if size >= slice_bytes:
                    yield rows(aligner, held)
                    held, size = [], 0
        if held:
            yield rows(aligner, held)

    return texts.mapInArrow(run, ROWS)


def _prepared(docs: DataFrame, a: bytes, b: bytes, text: str, digest: bool, slice_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of all slices; (slice, place, pair, weight) of their lists; (pair, a, count) of the corpus."""
    body = docs.select(F.col(text).alias("text")).filter("text <> ''")
    texts = body.groupBy("text").agg(F.count(F.lit(1)).alias("n_docs")).select(F.sha2("text", 256).alias("sha"), "n_docs", "text")
    aligned = materialize(align_texts(texts, a, b, digest, slice_bytes), "align-slices")
    lists = aligned.filter("sha IS NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "weights")).alias("place", "entry"))
    lists = lists.select("slice", "place", F.col("entry.pairs").alias("pair"), F.col("entry.weights").alias("weight"))
    counts = lists.groupBy("pair").agg(F.sum("weight").alias("count"))
    width = len(PieceTokens(b).tokens)
    return aligned, lists, materialize(counts.select("pair", F.expr(f"pair div {width}").alias("a"), "count"), "align-counts")


def pair_counts(docs: DataFrame, a: bytes, b: bytes, text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(a, b, count, best) of every two ids that any document links: how many do, and whether no other partner of ``a`` has more."""
    width = len(PieceTokens(b).tokens)
    _, _, counts = _prepared(docs, a, b, text, True, slice_bytes)
    return _with_best(counts).select("a", (F.col("pair") % width).alias("b"), "count", "best")


def _with_best(counts: DataFrame) -> DataFrame:
    # at most as many rows as A has ids
    top = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("top")))
    return counts.join(top, "a").select("pair", "a", "count", (F.col("count") == F.col("top")).alias("best"))


MEASURES = "sha string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def align_documents(
    docs: DataFrame, a: bytes, b: bytes, id: str = "doc_id", text: str = "text", digest: bool = False, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` has the ids of A and of B between places where tokens of both end, as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its
    SHA-256). A link is an occurrence of a token of A and one of B with a byte in common. The count of a pair of ids is the
    number of rows of ``docs`` that hold it linked; ``count_sum`` adds it up over links, ``n_best`` counts links whose count is the highest
    of their id of A, ties included. Texts that are NULL or empty, or that a tokenizer does not give back byte by byte, have
    zeros and ''. Equal texts are aligned once and count each. Rows with NULL or repeated ids are rows like others. An empty
    table gives no rows. Other columns are not read.
    """
    aligned, lists, counts = _prepared(docs, a, b, text, digest, slice_bytes)
    answers = lists.select("slice", "place", "pair").join(materialize(_with_best(counts).drop("a"), "align-best"), "pair").select(F.col("slice").alias("of_slice"), "place", "count", "best")
    texts = aligned.filter("sha IS NOT NULL").drop("pairs", "weights")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        count, best = np.zeros((2, len(place)), dtype=np.int64)
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        sums = []
        for data, n in zip(left["places"].to_pylist(), left["n_pairs"].to_pylist()):
            own, times = _unpacked(data, n)
            sums.append((int(best[own] @ times), int(count[own] @ times)))
        table = left.select(["sha", "n_a", "n_b", "n_groups", "n_links"])
        for k, name in enumerate(("n_best", "count_sum")):
            table = table.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return table.append_column("groups", left["groups"])

    measures = texts.groupBy("slice").cogroup(answers.groupBy("of_slice")).applyInArrow(measure, MEASURES)
    measures = materialize(measures, "align-measures")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    given = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    held = given.filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("sha")).join(measures, "sha").select("doc_id", *names)
    zeros = [F.lit(0).cast("bigint").alias(n) for n in names[:-1]]
    return held.unionByName(given.filter("text IS NULL OR text = ''").select("doc_id", *zeros, F.lit("").alias("groups")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document under both tokenizers, with the digest of its groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_documents(docs, load_model(BYTE_MODEL), load_model(MODEL), digest=True).withColumnRenamed("groups", "groups_sha256")
