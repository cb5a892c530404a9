"""SentencePiece encoding and decoding of whole texts, giant ones in parallel chunks.

A giant text is cut at fixed places. What a cut does to the pieces is unknown to a chunk, so it works out a transfer matrix
between its boundary states: a state of a cut is the first piece boundary at or after it, of which there are at most as
many as a piece has characters. An entry is the weight of the chunk's text between two such boundaries with its first and
last piece. Matrices of neighbours are combined over (max, +), which is associative: first those of a run of chunks, a run
per task, then those of all runs of a text. The best path through the runs fixes the boundaries of each run, from which the
runs are gone through again, apart from each other, for the boundaries of their chunks. Between two of them every chunk is
encoded again, independently of the others.

The vocabulary at hand is one of merges, for which a path has weight 0 if it is the encoding and minus infinity if not. A
row of pieces is the encoding of its text exactly if every two neighbours are the encoding of theirs. So matrices need to
look only at the two pieces that meet at a boundary. A text that fits into one chunk has the one state at both ends.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.sources.scratch import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15  # characters
BATCH_CHARS = 1 << 18
BATCH_IDS = 1 << 16  # that are decoded at a time
RUN = 64  # chunks whose matrices are combined in one task; a text then has one matrix for two million characters
TAIL = 256  # characters before a cut that are encoded anew for every state of the cut
BLANK_PIECE = "▁"
CHOSEN = "sha string, chunk int, enter bigint, leave bigint"


def load_model(path: str = MODEL) -> bytes:
    """The vocabulary file, read on the driver and sent along with the tasks (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


class Pieces:
    """The library with and without its own blank at the front, and what chunks need to know of the vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("chunks need a vocabulary that leaves the text as it is")
        self.prefix = BLANK_PIECE if proto.normalizer_spec.add_dummy_prefix else ""
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.size = [1 if p.type in (2, 6) else len(p.piece) for p in proto.pieces]  # unknown and byte pieces: one character
        self.longest = max(len(p.piece) for p in proto.pieces if p.type not in (2, 3, 6))
        self.begin = re.compile(f"(?<=[^{BLANK_PIECE}]){BLANK_PIECE}")
        # no piece has a blank after another character, so that a blank after one always begins a piece
        self.blank_begins = not any(BLANK_PIECE in p.piece.lstrip(BLANK_PIECE) for p in proto.pieces if p.type not in (2, 3, 6))

        # what a piece decodes to; byte, unknown and control pieces need the library
        self.plain_bytes = [b"" if p.type in (2, 3, 6) else p.piece.replace(BLANK_PIECE, " ").encode() for p in proto.pieces]
        self.needs_library = np.array([p.type in (2, 3, 6) for p in proto.pieces])
        self.byte_sizes = np.array([len(b) for b in self.plain_bytes], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.all_bytes = np.frombuffer(b"".join(self.plain_bytes), dtype=np.uint8)

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of the ids between every two ``cuts``: the bytes of their pieces without the blank that was put at the front."""
        ends = np.concatenate(([0], np.cumsum(self.byte_sizes[ids])))
        # a byte takes some 30 while it is looked up, so a few pieces at a time
        flat = b"".join(self._bytes(ids[a : a + BATCH_IDS]) for a in range(0, len(ids), BATCH_IDS))
        odd = np.concatenate(([0], np.cumsum(self.needs_library[ids])))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if odd[b] != odd[a]:
                out.append(self.whole.decode(ids[a:b].tolist()))
                continue
            text = flat[ends[a] : ends[b]].decode()
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.byte_sizes[ids]
        starts = np.cumsum(sizes) - sizes
        return self.all_bytes[np.arange(sizes.sum()) + np.repeat(self.byte_starts[ids] - starts, sizes)].tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts."""
        return [np.asarray(x, dtype=np.int32) for x in self.bare.encode(texts, num_threads=1)]

    def encode(self, text: str) -> list[int]:
        return self.bare.encode(text)

    def plain(self, text: str) -> str:
        """The text as the vocabulary sees it."""
        return self.prefix + text.replace(" ", BLANK_PIECE) if text else ""

    def states(self, text: str, cut: int) -> list[int]:
        """Where the first piece boundary at or after ``cut`` may be."""
        out = []
        for at in range(cut, min(cut + self.longest, len(text) + 1)):
            out.append(at)
            if at == len(text) or self.blank_begins and at and text[at] == BLANK_PIECE and text[at - 1] != BLANK_PIECE:
                break
        return out

    def sure_before(self, text: str, end: int) -> int:
        """The last place before ``end`` where a blank surely begins a piece, or 0."""
        at = text.rfind(BLANK_PIECE, 0, end)
        while at > 0 and text[at - 1] == BLANK_PIECE:
            at = text.rfind(BLANK_PIECE, 0, at)
        return max(at, 0)

    def meet(self, left: str, right: str) -> bool:
        """Whether two pieces may be neighbours."""
        return self.bare.encode(left + right) == self.bare.encode(left) + self.bare.encode(right)

    def between(self, text: str, enter: int, leave: int, body: tuple[int, list[int]] | None = None) -> list[int]:
        """Ids of ``text[enter:leave]``; ``body`` has the ids up to a place near the end, if they are known."""
        if body and body[0] < leave and body[1]:
            tail = self.encode(text[body[0] : leave])
            last, first = self.size[body[1][-1]], self.size[tail[0]]
            if self.meet(text[body[0] - last : body[0]], text[body[0] : body[0] + first]):
                return body[1] + tail
        return self.encode(text[enter:leave])

    def matrix(self, text: str, enters: list[int], cut: int, leaves: list[int]) -> list[tuple[int, int, float, str, str]]:
        """(enter, leave, weight, first piece, last piece) of every path through the chunk that ends at ``cut``.

        Where a blank surely begins a piece, what is between the first and the last such place is on every path; only the
        pieces before and after it are worked out.
        """
        sure = self.begin.search(text, enters[-1] + 1) if self.blank_begins else None
        if sure and self.sure_before(text, cut) >= sure.start():
            heads = [self.encode(text[a : sure.start()])[0] for a in enters]
            out = []
            for leave in leaves:
                last = self.size[self.encode(text[self.sure_before(text, leave) : leave])[-1]]
                if leave == cut or leave - last < cut:
                    out += [(a, leave, 0.0, text[a : a + self.size[h]], text[leave - last : leave]) for a, h in zip(enters, heads)]
            return out
        out = []
        for enter in enters:
            ids = self.encode(text[enter : max(enter, cut - TAIL)])
            body = None
            if len(ids) > 8:
                ids = ids[:-8]  # the last pieces depend on what follows
                while ids and self.size[ids[-1]] == 1:  # never within the bytes of a character
                    ids.pop()
                body = (enter + sum(self._sizes(ids)), ids)
            for leave in leaves:
                if leave <= enter:
                    continue
                got = self.between(text, enter, leave, body)
                first, last = self.size[got[0]], self.size[got[-1]]
                if leave == cut or leave - last < cut:  # no piece boundary between the cut and its state
                    out.append((enter, leave, 0.0, text[enter : enter + first], text[leave - last : leave]))
        return out

    def _sizes(self, ids: list[int]) -> list[int]:
        """Characters of each id; the bytes of one character count once."""
        out, need = [], 0
        for i in ids:
            piece = self.whole.id_to_piece(i)
            if len(piece) == 6 and piece.startswith("<0x"):
                byte = int(piece[3:5], 16)
                if need:
                    need -= 1
                    out.append(0)
                    continue
                need = 0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                out.append(1)
            else:
                out.append(self.size[i])
        return out

    def combine(self, left: dict, right: dict) -> dict:
        """The (max, +) product of two matrices {(enter, leave): (weight, first, last, boundaries passed)}.

        The boundaries passed are a pair of those of the left and the right with the one between them, so that an entry
        costs the same however long its path is.
        """
        by_enter: dict[int, list] = {}
        for (enter, leave), value in right.items():
            by_enter.setdefault(enter, []).append((leave, value))
        out: dict = {}
        known: dict[tuple[str, str], bool] = {}
        for (enter, middle), (w1, first, end, path1) in left.items():
            for leave, (w2, begin, last, path2) in by_enter.get(middle, ()):
                if (end, begin) not in known:
                    known[end, begin] = self.meet(end, begin)
                weight = w1 + w2 if known[end, begin] else -np.inf
                if weight > -np.inf and weight > out.get((enter, leave), (-np.inf,))[0]:
                    # an empty chunk at the end of a text has no pieces of its own
                    out[enter, leave] = (weight, first or begin, last or end, (path1, middle, path2))
        return out

    def product(self, matrices: list[dict]) -> dict:
        """All matrices combined, neighbours first."""
        while len(matrices) > 1:
            pairs = [self.combine(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)]
            matrices = pairs + matrices[len(matrices) - len(matrices) % 2 :]
        return matrices[0]


def _boundaries(path: tuple) -> list[int]:
    """The boundaries of a path through a product of matrices, from left to right."""
    out, todo = [], [path]
    while todo:
        part = todo.pop()
        if isinstance(part, int):
            out.append(part)
        elif part:
            todo += reversed(part)
    return out


def _arrow_ids(ids: list) -> pa.ListArray:
    sizes = np.fromiter((len(x) for x in ids), np.int32, len(ids))
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if len(ids) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, pa.int32()))


def _runs(sizes: list[int | None], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``limit``, or to more with the last of them."""
    first = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode_short(docs: DataFrame, model: bytes) -> DataFrame:
    """(…, ids) for the column ``text`` as last column, each text in one piece."""
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pieces(model)
        for batch in batches:
            for a, b in _runs(pc.utf8_length(batch.column(batch.num_columns - 1)).to_pylist(), BATCH_CHARS):
                part = batch.slice(a, b - a)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = tool.encode_all([tool.plain(t) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _arrow_ids(ids)], names=[*kept, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{fields}, ids array<int>")


def chunks_of(texts: DataFrame, prefix: str, longest: int, chunk: int) -> DataFrame:
    """(sha, chunk, chunks, begin, part): every chunk of the column ``text`` with the states of the cuts at both its ends.

    ``part`` begins one character before the chunk, and goes on until all states of the next cut are in it. A text is gone
    through once from front to back, and its chunks leave one by one.
    """
    names = ["sha", "chunk", "chunks", "begin", "part"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sha, plain = batch.column(0)[k].as_py(), prefix + batch.column(1)[k].as_py().replace(" ", BLANK_PIECE)
                chunks = -(-len(plain) // chunk)
                for first in range(0, chunks, 8):
                    own = range(first, min(first + 8, chunks))
                    begins = [max(c * chunk - 1, 0) for c in own]
                    parts = [plain[b : c * chunk + chunk + longest + 1] for c, b in zip(own, begins)]
                    columns = [[sha] * len(own), list(own), [chunks] * len(own), begins, parts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return texts.select("sha", "text").mapInArrow(run, "sha string, chunk int, chunks int, begin bigint, part string")


def encode_giant(texts: DataFrame, model: bytes, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """(sha, ids) for distinct giant texts (sha, text)."""
    tool = Pieces(model)
    # chunks are small for what they cost, so their number of tasks is not left to their size
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(chunks_of(texts, tool.prefix, tool.longest, chunk), "pieces-chunks")
    rows = cut.repartition(tasks, "sha", "chunk")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Pieces(model)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                cut = (r.chunk + 1) * chunk - r.begin
                enters = [0] if r.chunk == 0 else tool.states(r.part, r.chunk * chunk - r.begin)
                last = r.chunk == r.chunks - 1
                leaves = [len(r.part)] if last else tool.states(r.part, cut)
                for enter, leave, weight, a, b in tool.matrix(r.part, enters, len(r.part) if last else cut, leaves):
                    out.append((r.sha, r.chunk, enter + r.begin, leave + r.begin, weight, a, b))
                if last and len(r.part) in enters:  # the chunk before took all there is
                    out.append((r.sha, r.chunk, len(r.part) + r.begin, len(r.part) + r.begin, 0.0, "", ""))
            yield pd.DataFrame(out, columns=["sha", "chunk", "enter", "leave", "weight", "first", "last"])

    kind = "enter bigint, leave bigint, weight double, first string, last string"
    entries = rows.mapInPandas(matrices, f"sha string, chunk int, {kind}")
    entries = materialize(entries.withColumn("run", F.expr(f"chunk div {run}").cast("int")), "pieces-matrices")
    loaded: list[Pieces] = []  # once per task, not once per text

    def product(rows: pd.DataFrame, place: str) -> dict:
        """The product of the matrices of a group, in the order of the column ``place``."""
        if not loaded:
            loaded.append(Pieces(model))
        parts: dict[int, dict] = {}
        for at, *key, weight, first, last in zip(*(rows[c].tolist() for c in (place, "enter", "leave", "weight", "first", "last"))):
            parts.setdefault(at, {})[tuple(key)] = (weight, first, last, ())
        return loaded[0].product([parts[k] for k in sorted(parts)])

    def of_run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(*key, *at, *value[:3]) for at, value in product(rows, "chunk").items()]
        return pd.DataFrame(out, columns=["sha", "run", "enter", "leave", "weight", "first", "last"])

    def over_runs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = product(rows, "run")
        (enter, leave), value = max(whole.items(), key=lambda x: x[1][0])
        cuts = [enter, *_boundaries(value[3]), leave]
        return pd.DataFrame({"sha": key[0], "run": range(len(cuts) - 1), "enter": cuts[:-1], "leave": cuts[1:]})

    def within_run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        at = int(known["enter"].iloc[0]), int(known["leave"].iloc[0])
        cuts = [at[0], *_boundaries(product(rows, "chunk")[at][3]), at[1]]
        first = int(rows["chunk"].min())
        return pd.DataFrame({"sha": key[0], "chunk": range(first, first + len(cuts) - 1), "enter": cuts[:-1], "leave": cuts[1:]})

    # these rows are few, but each costs much: their number of tasks is not left to their size either
    entries = entries.repartition(tasks, "sha", "run")
    runs = entries.groupBy("sha", "run").applyInPandas(of_run, f"sha string, run int, {kind}")
    fixed = runs.groupBy("sha").applyInPandas(over_runs, "sha string, run int, enter bigint, leave bigint")
    fixed = fixed.select(F.col("sha").alias("of"), F.col("run").alias("number"), "enter", "leave")
    chosen = entries.groupBy("sha", "run").cogroup(fixed.groupBy("of", "number")).applyInPandas(within_run, CHOSEN)
    paired = cut.join(chosen, ["sha", "chunk"]).repartition(tasks, "sha", "chunk")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Pieces(model)
        for batch in batches:
            for first, end in _runs((batch["leave"] - batch["enter"]).tolist(), BATCH_CHARS):
                part = batch.iloc[first:end]
                ids = tool.encode_all([p[a - b : e - b] for p, a, e, b in zip(part["part"], part["enter"], part["leave"], part["begin"])])
                yield pd.DataFrame({"sha": part["sha"], "chunk": part["chunk"], "ids": ids})

    own = paired.select("sha", "chunk", "begin", "part", "enter", "leave").mapInPandas(encode, "sha string, chunk int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return own.groupBy("sha").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def encode_documents(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (the library's encoding of the whole text).

    NULL counts as the empty text, which has no ids. Repeated rows are encoded each; equal giant texts once. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk
    short = encode_short(rows.filter(~giant), model)
    long = rows.filter(giant).select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    found = encode_giant(long.select("sha", "text").dropDuplicates(["sha"]), model, chunk)
    return short.unionByName(long.select("doc_id", "sha").join(found, "sha").select("doc_id", "ids"))


def decode_ids(encoded: DataFrame, model: bytes) -> DataFrame:
    """The columns of ``encoded``, the last of which is ``ids``, and ``decoded``, the text of the ids; NULL ids give ''.

    Decoding gives the text that was encoded, but for the character U+2581, by which the vocabulary writes a blank.
    """
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pieces(model)
        for batch in batches:
            for a, b in _runs(pc.list_value_length(batch.column(batch.num_columns - 1)).to_pylist(), BATCH_IDS):
                part = batch.slice(a, b - a)
                ids = part.column(part.num_columns - 1)
                cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
                texts = tool.decode_all(ids.flatten().to_numpy().astype(np.int64), cuts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) of every document; the last is the digest of the text that the ids decode to.

    The ids are written once in between, so that a task never holds a Python worker that encodes and one that decodes.
    """
    model = load_model()
    decoded = decode_ids(materialize(encode_documents(docs, model), "pieces-ids", compression="zstd"), model)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of the text they decode to."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
