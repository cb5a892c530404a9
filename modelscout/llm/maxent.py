"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). Classes are bands of the words' frequency, so that each holds about
the same share of all tokens; within a class a word has its smoothed relative frequency. The class factor is a softmax over
hashed features of the history: the word before, the two and the three words before, and the word before that one (a skip).
Its weights are trained by rounds of distributed gradient steps: every task goes through its part of the round's texts from
the weights sent out, and what the tasks learnt about a bucket is averaged by how often each met it. The number of buckets
grows with the square root of the training tokens, as do a task's tokens, so that what all tasks send stays in proportion to the
text: one row of 8-bit steps with a scale of its own for every bucket that a task met. Weights are sent out in 16 bits.

Words are known by 64-bit numbers. Counts of the most frequent words, of a bounded number, are sent to all tasks; the other
words of a text are joined with their counts by a shuffle.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.llm.words import mix, powers, words
from modelscout.sources.scratch import materialize

SENT_WORDS = 1 << 20  # most frequent words whose counts go to all tasks: 12 bytes each
CLASSES = 16  # the last one holds the words that are not sent, and unknown ones
FEATURES = 4
BUCKETS = 1 << 14  # per kind of feature, at least
GROWTH = 14.0  # buckets of a kind for the square root of the training tokens, once that is more
PLACE = 1 << 10  # buckets that are added up together
ROUNDS = 3
STEP_TOKENS = 1 << 15
SCORE_ROWS = 4000  # whose class scores are worked out together, so that they stay in a core's cache
FEW = 8  # rows of a bucket, at most, that are added up for all such buckets at once
PROBES = 8  # places next to where a number should be that are looked at before it is searched for
RATE = 0.5
TASK_TOKENS = 1 << 20  # that a task goes through in a round, at least: what it sends is worth it
BUCKET_HITS = 4  # tokens of a task for every bucket of all kinds, at least
STEP_BYTES = 1 << 21  # of texts that are looked at together; where training makes its steps follows from it
ADDED = 64  # tasks whose steps are added up in the first step
END = np.uint64(0x452821E638D01377)  # the number of the end of a text
SALTS = mix(np.arange(FEATURES, dtype=np.uint64) + np.uint64(11))


def fold(id: str, folds: int = 5) -> F.Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, tokens, where each text's begin) for slices of texts; every text ends with END."""
    for a, b, w, cuts in words(texts, lower=True, limit=STEP_BYTES):
        yield a, b, np.insert(w, cuts[1:], END), cuts + np.arange(len(cuts))


def buckets_for(total: int, growth: float = GROWTH) -> int:
    """Buckets per kind of feature for so many training tokens: whole places, without an upper limit."""
    return max(BUCKETS, math.ceil(growth * math.sqrt(total) / PLACE) * PLACE)


def features(w: np.ndarray, cuts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each of the FEATURES of every token; the start of the text stands for what is before it."""
    first = np.repeat(cuts[:-1], np.diff(cuts))
    at = np.arange(len(w))

    def before(k: int) -> np.ndarray:
        out = np.zeros(len(w), dtype=np.uint64)
        out[k:] = w[:-k] if k else w
        out[at - k < first] = k
        return out

    one, two, three = before(1), before(2), before(3)
    p = powers(4)
    pair = one + two * p[1]
    kinds = (one, pair, pair + three * p[2], two)
    # a kind's buckets lie together, as they are read
    return np.stack([(mix(x ^ s) >> np.uint64(24)).astype(np.int64) % buckets + k * buckets for k, (x, s) in enumerate(zip(kinds, SALTS))]).T


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the words that are sent, in the order of their numbers, their classes, and totals of all training tokens."""

    number: np.ndarray
    count: np.ndarray
    class_: np.ndarray
    total: int  # N
    distinct: int  # V
    log_mass: np.ndarray  # log10 of each class's smoothed mass
    log_share: np.ndarray  # natural log of each class's share of the training tokens

    @cached_property
    def _first(self) -> np.ndarray:
        """Place of the first number with given leading bits, one more than it takes to tell as many numbers apart."""
        bits = len(self.number).bit_length()
        leading = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.minimum(np.searchsorted(self.number, leading), len(self.number) - 1).astype(np.int32)

    def _places(self, w: np.ndarray) -> np.ndarray:
        """Place of every number that is there, and any place for the others."""
        at = self._first[(w >> np.uint64(64 - len(self.number).bit_length())).astype(np.int64)]
        last = len(self.number) - 1
        open_ = np.flatnonzero(self.number[at] < w)
        for _ in range(PROBES):
            if not len(open_):
                return at
            at[open_] = np.minimum(at[open_] + 1, last)
            open_ = open_[(self.number[at[open_]] < w[open_]) & (at[open_] < last)]
        at[open_] = np.minimum(np.searchsorted(self.number, w[open_]), last)
        return at

    def look_up(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class) of every token; count 0 and the last class for words that are not sent."""
        if not len(self.number):
            return np.zeros(len(w), dtype=np.int64), np.full(len(w), CLASSES - 1)
        at = self._places(w)
        known = self.number[at] == w
        return np.where(known, self.count[at], 0), np.where(known, self.class_[at], CLASSES - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the column ``text``; every task adds up a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [w for _, _, w, _ in tokens(batch.column(0))]
            word, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, sent_words: int = SENT_WORDS) -> Vocabulary:
    """The words above the lowest count at which no more than ``sent_words`` words are sent."""
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(totals["n"] or 0), int(totals["v"])
    # words by powers of 2 ** (1/4) of their count: a few hundred rows whatever the table holds
    step = F.floor(F.log2("n") * 4).cast("int")
    by_size = counts.groupBy(step.alias("size")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    least, so_far = total + 1, 0
    for r in by_size:
        so_far += r["v"]
        if so_far > sent_words:
            break
        least = r["least"]
    sent = counts.filter(F.col("n") >= least).select("word", "n").toArrow()
    number, count = sent["word"].to_numpy().astype(np.int64).view(np.uint64), sent["n"].to_numpy().astype(np.int64)
    order = np.argsort(number)
    number, count = number[order], count[order]
    # frequent words first; each class has about as many tokens
    by_count = np.lexsort((number, -count))
    share = np.cumsum(count[by_count])
    class_ = np.zeros(len(count), dtype=np.int8)
    class_[by_count] = np.minimum((share - 1) * (CLASSES - 1) // max(int(share[-1]) if len(share) else 1, 1), CLASSES - 2)
    tokens_in = np.bincount(class_, weights=count, minlength=CLASSES)
    words_in = np.bincount(class_, minlength=CLASSES).astype(float)
    rest = total - tokens_in.sum()
    tokens_in[-1] = rest
    words_in[-1] = distinct - len(count) + 1  # the words that are not sent, and one that nobody has seen
    mass = tokens_in + 0.5 * words_in
    return Vocabulary(number, count, class_, total, distinct, np.log10(np.maximum(mass, 1e-300)), np.log(np.maximum(mass, 1e-12) / mass.sum()))


def _class_scores(weights: np.ndarray, base: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes for rows of feature buckets."""
    out = np.empty((len(f), CLASSES), dtype=np.result_type(weights, base))
    for a in range(0, len(f), SCORE_ROWS):
        part = f[a : a + SCORE_ROWS]
        rows = base + np.take(weights, part[:, 0], axis=0)
        for k in range(1, f.shape[1]):
            rows += np.take(weights, part[:, k], axis=0)
        z = np.ascontiguousarray(rows.T)  # a row per class: what goes over the classes takes whole rows
        z -= z.max(axis=0)
        z -= np.log(_over_classes(np.exp(z)))
        out[a : a + SCORE_ROWS] = z.T
    return out


def _over_classes(x: np.ndarray) -> np.ndarray:
    """Sums over the first axis, a power of 2 long: the halves first, then neighbours, as numpy adds up 16 floats in a row."""
    x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(x) > 1:
        x = x[0::2] + x[1::2]
    return x[0]


def _sums(x: np.ndarray, order: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``np.add.reduceat(x[order], starts)`` gives, with its order of additions; most groups have a few rows only."""
    out = np.take(x, order[starts], axis=0)
    few = np.flatnonzero((n > 1) & (n <= FEW))
    few = few[np.argsort(-n[few], kind="stable")]
    if len(few):
        at, size = starts[few], n[few]
        rest = np.take(x, order[at + 1], axis=0)
        for k in range(2, int(size[0])):
            larger = int(np.searchsorted(-size, -k))
            rest[:larger] += np.take(x, order[at[:larger] + k], axis=0)
        out[few] += rest
    many = n > FEW
    if many.any():
        out[many] = np.add.reduceat(np.take(x, order[np.repeat(many, n)], axis=0), np.cumsum(n[many]) - n[many])
    return out


def train_step(weights: np.ndarray, seen: np.ndarray, base: np.ndarray, f: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step on the class factor; a bucket's step shrinks with the square root of how often it was seen."""
    gradient = -np.exp(_class_scores(weights, base, f))
    gradient[np.arange(len(f)), target] += 1
    bits = len(f).bit_length()
    row = np.arange(len(f))
    for k in range(f.shape[1]):
        # bucket and row in one number: sorting these is faster than a stable order of buckets, which it gives
        both = np.sort(f[:, k] << bits | row)
        order, bucket = both & (1 << bits) - 1, both >> bits
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = bucket[starts]
        n = np.diff(np.append(starts, len(bucket)))
        seen[rows] += n
        moved = np.take(weights, rows, axis=0)
        moved += (rate / f.shape[1]) * _sums(gradient, order, starts, n) / np.sqrt(n * seen[rows])[:, None]
        weights[rows] = moved


STEPS = "place bigint, share int, at binary, moved binary, scale binary, met binary"


def _eight_bits(moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps as whole numbers up to 127 and the scale of each row."""
    scale = np.abs(moved).max(axis=1) / 127
    return np.rint(moved / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8), scale.astype(np.float32)


def _packed(at: np.ndarray, moved: np.ndarray, met: np.ndarray) -> list[bytes]:
    steps, scale = _eight_bits(moved)
    return [(at % PLACE).astype("<i2").tobytes(), steps.tobytes(), scale.astype("<f4").tobytes(), met.astype("<f4").tobytes()]


def _unpacked(at: bytes, moved: bytes, scale: bytes, met: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, moved, met) of a row."""
    steps = np.frombuffer(moved, dtype=np.int8).reshape(-1, CLASSES)
    return np.frombuffer(at, dtype="<i2").astype(np.int64), steps * np.frombuffer(scale, dtype="<f4")[:, None], np.frombuffer(met, dtype="<f4")


def _send(at: np.ndarray, moved: np.ndarray, met: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    """Rows of STEPS of buckets ``at``, in order: one row per place that has any of them."""
    starts = np.flatnonzero(np.concatenate(([True], at[1:] // PLACE != at[:-1] // PLACE)))
    ends = np.append(starts[1:], len(at))
    for k in range(0, len(starts), 16):
        rows = [(int(at[a]) // PLACE, share, *_packed(at[a:b], moved[a:b], met[a:b])) for a, b in zip(starts[k : k + 16], ends[k : k + 16])]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["place", "share", "at", "moved", "scale", "met"])


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a place as one."""
    moved, met = np.zeros((PLACE, CLASSES)), np.zeros(PLACE)
    for row in zip(rows["at"], rows["moved"], rows["scale"], rows["met"]):
        at, m, n = _unpacked(*row)
        moved[at] += m
        met[at] += n
    at = np.flatnonzero(met)
    return pd.DataFrame([(key[0], 0, *_packed(at, moved[at], met[at]))], columns=["place", "share", "at", "moved", "scale", "met"])


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = RATE, growth: float = GROWTH) -> np.ndarray:
    """Weights (buckets, classes), in 16 bits, after one pass over all texts of ``docs`` (id, text), a part of them in each round.

    What comes back from a round is a row of weights per bucket that was met: the tasks' steps are added up by the shuffle.
    """
    spark = docs.sparkSession
    buckets = buckets_for(vocab.total, growth)
    weights = np.zeros((FEATURES * buckets, CLASSES), dtype=np.float16)
    if vocab.total == 0:
        return weights
    sent = spark.sparkContext.broadcast(vocab)
    base = vocab.log_share.astype(np.float32)
    # tasks follow the tokens and not the files: what a task sends should be worth it
    tasks = max(1, math.ceil(vocab.total / rounds / max(TASK_TOKENS, BUCKET_HITS * len(weights))))
    shares = math.ceil(tasks / ADDED)
    for round_ in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, seen = start.value.astype(np.float32), np.zeros(FEATURES * buckets, dtype=np.float32)
            for batch in batches:
                for _, _, t, cuts in tokens(batch.column(0)):
                    f, target = features(t, cuts, buckets), sent.value.look_up(t)[1]
                    for a in range(0, len(t), STEP_TOKENS):
                        train_step(w, seen, base, f[a : a + STEP_TOKENS], target[a : a + STEP_TOKENS], rate)
            at = np.flatnonzero(seen)
            if not len(at):
                return
            met = seen[at]
            yield from _send(at, (w[at] - start.value[at]) * met[:, None], met, TaskContext.get().partitionId() % shares)

        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == round_).select("text").coalesce(tasks)
        steps = part.mapInArrow(run, STEPS)
        # in two steps, so that no task adds up what all tasks of a large run send
        total = steps.groupBy("place", "share").applyInPandas(_add, STEPS).groupBy("place").applyInPandas(_add, STEPS).toArrow()
        for place, *row in zip(*(total[c].to_pylist() for c in ("place", "at", "moved", "scale", "met"))):
            at, moved, met = _unpacked(*row)
            weights[place * PLACE + at] += moved / met[:, None]
        start.unpersist()
    return weights


def _scored(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    """(doc_id, row, n_tokens, n_known, base, score, rare): what is known without the words that are not sent.

    ``rare`` has the numbers of those words; the logarithm of their smoothed counts is still to be added to both scores.
    """
    spark = docs.sparkSession
    sent, table, buckets = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(weights), len(weights) // FEATURES
    log_all = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_class, number = sent.value.log_share.astype(np.float32), TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, t, cuts in tokens(batch.column(1)):
                count, class_ = sent.value.look_up(t)
                f = features(t, cuts, buckets)
                log_class = np.concatenate([
                    _class_scores(table.value, base_class, f[k : k + STEP_TOKENS])[np.arange(len(f[k : k + STEP_TOKENS])), class_[k : k + STEP_TOKENS]]
                    for k in range(0, len(t), STEP_TOKENS)
                ]).astype(np.float64)
                known = count > 0
                own = np.where(known, np.log10(count + 0.5), 0.0)
                starts = cuts[:-1]
                base = np.add.reduceat(own - log_all, starts)
                score = np.add.reduceat(own - sent.value.log_mass[class_] + log_class / math.log(10), starts)
                rare = np.flatnonzero(~known)
                ends = np.searchsorted(rare, cuts).astype(np.int32)
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(np.arange(number, number + b - a)), pa.array(np.diff(cuts)),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(t[rare].view(np.int64))),
                ]
                number += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "n_known", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def language_model_scores(docs: DataFrame, learn: F.Column, id: str = "doc_id", text: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of probabilities).

    ``learn`` is a condition on the column ``doc_id``: the rows to learn from. NULL and empty texts have one token, the end, and
    are learnt from and scored like any. Repeated rows count and are scored each. Where nothing is learnt from, a word has the
    probability of an unseen one. Equal logarithms are those of equal counts, whatever the order of the words. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learnt = rows.filter(learn)
    counts = materialize(word_counts(learnt), "maxent-counts")
    vocab = vocabulary(counts, sent_words)
    weights = train(learnt, vocab)
    scored = materialize(_scored(rows, vocab, weights), "maxent-scored")

    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    own = F.coalesce(F.col("n"), F.lit(0))
    per_word = rare.join(counts, "word", "left").select(
        "row", (F.col("times") * F.log10(own + 0.5)).alias("own"), F.when(own > 0, F.col("times")).otherwise(0).alias("known")
    )
    per_row = per_word.groupBy("row").agg(F.sum("own").alias("own"), F.sum("known").alias("known"))
    add = F.coalesce("own", F.lit(0.0))
    return scored.drop("rare").join(per_row, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"),
    )


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = language_model_scores(docs, fold("doc_id") != 1)
    return scores.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
