"""Removal of long passages that an earlier document has, by suffix automata of reference shards.

1. Every window of ``window`` words is given an anchor, the run of ``gram`` words in it with the smallest hash. Equal windows
   have equal anchors, so only anchors that more than one document has can belong to repeated windows.
2. The windows of one anchor in one text form a context, a passage of at most 2 * window words. A document that has the very
   context of an earlier document loses all of it. Distinct contexts of repeated anchors are the reference.
3. The reference is cut into shards by anchor, so that all passages that can match meet in one shard of bounded size. A shard
   streams its contexts in the order of documents through the suffix automaton of the contexts before: where the longest
   match that ends at a word has ``window`` words or more, the window that ends there starts in an earlier document.
4. What is found is joined back to the texts.

The reference of a corpus has no size bound, so an automaton is not sent to all tasks but to the one where the passages of
its shard stream. An anchor with more contexts than a shard may hold is decided by exact hashes of its windows, added up
before they are shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.llm.words import STEP, bytes_of, mix, numbers, powers, slices, spans, words
from modelscout.sources.scratch import materialize

WINDOW = 50
GRAM = 16
SHARD_WORDS = 100_000
HOT_CONTEXTS = 4096  # of one anchor
SLICE_BYTES = 1 << 19  # of texts that are looked at together; a task needs some forty times as much
PLACE_BITS = np.uint64(28)
_inverse = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the inverse of STEP modulo 2**64."""
    global _inverse
    if len(_inverse) < n:
        factors = np.full(max(n, 2 * len(_inverse)), pow(STEP, -1, 2**64), dtype=np.uint64)
        factors[0] = 1
        _inverse = np.multiply.accumulate(factors)
    return _inverse


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive keys that begin at each place (fewer at the end)."""
    top = np.iinfo(np.uint64).max
    padded = np.full((len(key) // width + 2) * width, top, dtype=np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(key)], ahead[width - 1 : len(key) + width - 1])


def prefix_sums(w: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * powers(len(w) + 1)[: len(w)], dtype=np.uint64)))


def run_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from ``begin`` to ``end``, the same wherever the run stands."""
    return mix((sums[end] - sums[begin]) * inverse_powers(len(sums))[begin] + (end - begin).astype(np.uint64))


def contexts(w: np.ndarray, cuts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, digest, text, first word, windows) of every context in a slice of texts."""
    sizes = np.diff(cuts)
    end = np.repeat(cuts[1:], sizes)
    starts = np.flatnonzero(np.arange(len(w)) + window <= end)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = np.zeros(len(w), dtype=np.uint64)
    for k in range(gram):
        grams[: len(w) - k] += w[k:] * powers(gram)[k]
    grams = mix(grams)
    key = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(w), dtype=np.uint64)
    at = (sliding_least(key, window - gram + 1)[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo, n = starts[first], np.diff(np.append(first, len(starts)))
    text = np.searchsorted(cuts, lo, side="right") - 1
    return grams[at[first]], run_hashes(prefix_sums(w), lo, lo + n + window - 1), text, lo - cuts[text], n


class SuffixAutomaton:
    """All substrings of the sequences put in so far."""

    def __init__(self) -> None:
        self.follow: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        follow, link, length = self.follow, self.link, self.length
        last = 0
        for x in sequence:
            known = follow[last].get(x)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, x, known)
                continue
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and x not in follow[p]:
                follow[p][x] = new
                p = link[p]
            if p >= 0:
                q = follow[p][x]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, x, q)
            last = new

    def _split(self, p: int, x: int, q: int) -> int:
        """A state for the strings of ``q`` that are no longer than those of ``p`` with ``x``."""
        follow, link, length = self.follow, self.link, self.length
        twin = len(follow)
        follow.append(dict(follow[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and follow[p].get(x) == q:
            follow[p][x] = twin
            p = link[p]
        return twin

    def matches(self, sequence: list[int]) -> list[int]:
        """For every place of ``sequence``, the length of the longest match that ends there (matching statistics)."""
        follow, link, length = self.follow, self.link, self.length
        out, state, n = [], 0, 0
        for x in sequence:
            while x not in follow[state] and state:
                state = link[state]
                n = length[state]
            if x in follow[state]:
                state = follow[state][x]
                n += 1
            out.append(n)
        return out


def repeated_windows(passages: list[tuple[int, list[int]]], window: int) -> list[list[int]]:
    """For every (document, words): the windows of it that also start in a passage of a document with a smaller number."""
    order = sorted(range(len(passages)), key=lambda k: passages[k][0])
    automaton, found = SuffixAutomaton(), [[] for _ in passages]
    at = 0
    while at < len(order):
        same = _same(order, passages, at)
        for k in same:
            found[k] = [e - window + 1 for e, n in enumerate(automaton.matches(passages[k][1])) if n >= window]
        for k in same:
            automaton.add(passages[k][1])
        at += len(same)
    return found


def _same(order: list[int], passages: list[tuple[int, list[int]]], at: int) -> list[int]:
    """The passages in ``order`` from ``at`` on that are of one document."""
    end = at
    while end < len(order) and passages[order[end]][0] == passages[order[at]][0]:
        end += 1
    return order[at:end]


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """(first, number) of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][0] + out[-1][1] == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def anchors_of(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, low, high): the smallest and largest document with each anchor, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            parts = [(c[0], ids[a + c[2]]) for a, b, w, cuts in words(batch.column(2), limit=SLICE_BYTES) for c in (contexts(w, cuts, window, gram),)]
            anchor = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            doc = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(anchor, kind="stable")
            anchor, doc = anchor[order], doc[order]
            start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
            low, high = (f.reduceat(doc, start) if len(start) else doc for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[start].view(np.int64)), pa.array(low), pa.array(high)], names=["anchor", "low", "high"])

    return texts.mapInArrow(run, "anchor bigint, low bigint, high bigint")


def contexts_of(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, digest, doc_id, row, lo, n): every context of every text (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, _, w, cuts in words(batch.column(2), limit=SLICE_BYTES):
                anchor, digest, text, lo, n = contexts(w, cuts, window, gram)
                columns = [anchor.view(np.int64), digest.view(np.int64), ids[a + text], rows[a + text], lo.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "doc_id", "row", "lo", "n"])

    return texts.mapInArrow(run, "anchor bigint, digest bigint, doc_id bigint, row bigint, lo int, n int")


def _passages(asked: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, doc_id, words) of (wanted array of anchor, digest, doc_id, lo, n; text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for a, b, w, cuts in words(batch.column(1), limit=SLICE_BYTES):
                out = [(x["anchor"], x["digest"], x["doc_id"], w[cuts[k] + x["lo"] : cuts[k] + x["lo"] + x["n"] + window - 1]) for k in range(b - a) for x in wanted[a + k]]
                for c in range(0, len(out), 20_000):
                    part = out[c : c + 20_000]
                    sizes = np.cumsum([0] + [len(x[3]) for x in part]).astype(np.int32)
                    flat = pa.array(np.concatenate([x[3] for x in part]).view(np.int64))
                    arrays = [pa.array([x[k] for x in part], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["anchor", "digest", "doc_id", "words"])

    return asked.mapInArrow(run, "anchor bigint, digest bigint, doc_id bigint, words array<bigint>")


def _hot_windows(passages: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, runs) as a shard gives them, for the passages of anchors with too many contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["words"].map(len).to_numpy()
            ends = np.cumsum(sizes)
            w = np.concatenate(batch["words"].to_numpy()).view(np.uint64)
            # a window begins at every place but the last ones of its passage
            row = np.repeat(np.arange(len(sizes)), sizes - window + 1)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes - window + 1) - (sizes - window + 1), sizes - window + 1)
            begin = (ends - sizes)[row] + at
            one, two = (run_hashes(prefix_sums(x), begin, begin + window).view(np.int64) for x in (w, mix(w + np.uint64(1))))
            out = batch[["anchor", "digest", "doc_id"]].iloc[row].reset_index(drop=True)
            yield out.assign(at=at.astype(np.int32), w1=one, w2=two)

    each = passages.mapInPandas(run, "anchor bigint, digest bigint, doc_id bigint, at int, w1 bigint, w2 bigint")
    first = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"))
    later = each.join(first, ["w1", "w2"]).filter("low < doc_id")
    one = F.struct(F.col("at").alias("lo"), F.lit(1).alias("n"))
    return later.groupBy("anchor", "digest").agg(F.collect_list(one).alias("runs"))


def repeated_spans(texts: DataFrame, placed: DataFrame, window: int, gram: int, shard_words: int, hot_contexts: int) -> DataFrame:
    """(row, spans array of (lo, n) in words) for every row of texts (doc_id, row, text) that loses some words.

    ``placed`` has the same rows dealt by ``row``.
    """
    low_high = anchors_of(texts, window, gram).groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # written out, so that the contexts of a very frequent anchor can be dealt to several tasks
    repeated = materialize(low_high.filter("low < high").select("anchor"), "substring-anchors")
    found = materialize(contexts_of(texts, window, gram).join(repeated, "anchor"), "substring-contexts")
    first = found.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "row", "lo", "n")).alias("at"))
    first = materialize(first.select("anchor", "digest", "at.*"), "substring-reference")

    # most anchors have few contexts; those with too many are decided apart
    total = first.agg(F.sum(F.col("n") + window - 1).alias("words")).first()["words"] or 0
    shards = max(1, -(-int(total) // shard_words))
    hot = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_contexts).select("anchor", F.lit(True).alias("hot"))
    wanted = first.join(hot, "anchor", "left")
    requests = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "doc_id", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    asked = placed.join(requests, "row")

    def of(hot: bool) -> DataFrame:
        own = F.filter("wanted", lambda x: x["hot"] == hot)
        return _passages(asked.select(own.alias("wanted"), "text").filter(F.size("wanted") > 0), window)

    def stream(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["words"].map(len).to_numpy()
        _, code = np.unique(np.concatenate(rows["words"].to_numpy()), return_inverse=True)
        each = [c.tolist() for c in np.split(code, np.cumsum(size)[:-1])]
        runs = [_runs(x) for x in repeated_windows(list(zip(rows["doc_id"].tolist(), each)), window)]
        some = [k for k, x in enumerate(runs) if x]
        return pd.DataFrame({
            "anchor": rows["anchor"].to_numpy()[some], "digest": rows["digest"].to_numpy()[some],
            "runs": pd.Series([[{"lo": a, "n": b} for a, b in runs[k]] for k in some], dtype=object),
        })

    kind = "anchor bigint, digest bigint, runs array<struct<lo:int,n:int>>"
    sharded = of(False).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    earlier = sharded.groupBy("shard").applyInPandas(stream, kind)
    if not hot.isEmpty():
        earlier = earlier.unionByName(_hot_windows(of(True), window))
    known = first.select("anchor", "digest", F.col("doc_id").alias("low")).join(earlier, ["anchor", "digest"], "left")
    # written out, so that the rows of a context that very many documents share can be dealt to several tasks
    known = materialize(known, "substring-known")

    whole = F.array(F.struct(F.col("lo"), (F.col("n") + window - 1).alias("n")))
    part = F.transform("runs", lambda x: F.struct((F.col("lo") + x["lo"]).alias("lo"), (x["n"] + window - 1).alias("n")))
    spans_ = F.when(F.col("doc_id") > F.col("low"), whole).otherwise(part)
    lost = found.join(known, ["anchor", "digest"]).select("row", spans_.alias("spans")).filter("spans IS NOT NULL")
    # a set, because rows that repeat an id and a text share their number
    return lost.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _cut(marked: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of (doc_id, spans, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(batch.column(2))
            for a, b in slices(bounds, SLICE_BYTES):
                part, cuts = data[bounds[a] : bounds[b]].copy(), bounds[a : b + 1] - bounds[a]
                begin, end = spans(part, cuts)
                at = np.searchsorted(begin, cuts)
                lost = np.zeros(len(begin) + 1, dtype=np.int64)
                for k, found in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    for x in found or ():
                        lost[at[k] + x["lo"]] += 1
                        lost[at[k] + x["lo"] + x["n"]] -= 1
                kept = np.cumsum(lost[:-1]) == 0
                # the bytes of kept words, and one blank after each that another follows in its text
                fill = np.zeros(len(part) + 1, dtype=np.int64)
                np.add.at(fill, begin[kept], 1)
                np.add.at(fill, end[kept], -1)
                stay = np.cumsum(fill[:-1]) > 0
                doc = np.repeat(np.arange(b - a), np.diff(at))[kept]
                inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, dtype=np.int64)
                gap = end[kept][inner]
                part[gap], stay[gap] = 0x20, True
                left = np.concatenate(([0], np.cumsum(stay)))[cuts]
                kept_text = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(part[stay].tobytes()))
                n_words = np.diff(at)
                n_kept = np.bincount(doc, minlength=b - a)[: b - a]
                columns = [batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(n_words - n_kept), kept_text.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeated_passages(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id: str = "doc_id", text: str = "text",
    shard_words: int = SHARD_WORDS, hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    Words are runs of characters other than white space, unchanged. A word goes if it is in a window of ``window`` consecutive
    words of its text that also starts in a document with a smaller id, whatever that one loses itself. NULL texts have no
    words; texts shorter than a window lose none. Rows that repeat an id are texts of one document and take nothing from
    each other. Rows with a NULL id lose nothing and take nothing from others. An empty table gives no rows. Other columns
    are not read.
    """
    if not 0 < gram < window:
        raise ValueError("a gram is shorter than a window")
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id), body).alias("row"), body.alias("text"))
    texts = given.filter("doc_id IS NOT NULL")
    # one shuffle of the texts serves both joins with them
    placed = given.repartition("row")
    lost = repeated_spans(texts, placed, window, gram, shard_words, hot_contexts)
    return _cut(placed.join(lost, "row", "left").select("doc_id", "spans", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
