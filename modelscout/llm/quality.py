"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

Training is two exact aggregates (class sizes, sums, sums of products) over all labelled rows, so its result to the driver is
a few hundred numbers whatever the table holds. A class covariance is shrunk towards the pooled one and its diagonal
is raised; its Cholesky factor is computed once and scores whole batches of rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.llm.words import BLANK, bytes_of, numbers, slices, spans
from modelscout.sources.scratch import materialize

FEATURES = (
    "log_words", "word_length", "upper", "marks", "symbols", "digits", "bars", "wide", "repeated", "novelty", "line_words", "same_lines",
)
POOLED = 0.3  # share of the pooled covariance
ROUND = 0.05  # share of the pooled variances that is added to the diagonal
PRIOR_BYTES = 20.0  # added to the size of a text in shares of characters, so that a single word is no extreme
THRESHOLD = 0.3

_IS = {name: np.zeros(256, dtype=bool) for name in ("upper", "letter", "marks", "symbols", "digits", "bars", "wide")}
_IS["upper"][65:91] = True
_IS["letter"][65:91] = _IS["letter"][97:123] = True
for _name, _chars in (("marks", b"!?"), ("symbols", b"#$%&*@^~=<>{}[]\\_`+"), ("digits", b"0123456789"), ("bars", b"|")):
    _IS[_name][list(_chars)] = True
_IS["wide"][0xC0:] = True  # first byte of a character beyond ASCII


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, all finite; an empty text has zeros."""
    data, bounds = bytes_of(texts)
    out = np.zeros((len(bounds) - 1, len(FEATURES)))
    for a, b in slices(bounds):
        part, cuts = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        out[a:b] = _slice_statistics(part, cuts)
    return out


def _slice_statistics(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    n = len(cuts) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[cuts[1:]] - total[cuts[:-1]]).astype(float)

    begins, ends = spans(data, cuts)
    w = numbers(data, begins, ends)
    at = np.searchsorted(begins, cuts)
    count = np.diff(at).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    solid = per_text(~BLANK[data])
    share = {k: per_text(m[data]) for k, m in _IS.items()}
    some, letters = solid + PRIOR_BYTES, share["letter"] + PRIOR_BYTES

    same = np.zeros(len(w), dtype=bool)
    same[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w, doc))
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)[:n]

    breaks = data == 10
    lines = per_text(breaks) + 1
    # a line is known by the sum of its words' numbers
    line = np.concatenate(([0], np.cumsum(breaks)))[begins] + doc
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(w) else np.zeros(0, dtype=int)
    sums = np.add.reduceat(w, first) if len(first) else np.zeros(0, dtype=np.uint64)
    line_doc = doc[first] if len(first) else np.zeros(0, dtype=int)
    by = np.lexsort((sums, line_doc))
    twice = np.zeros(len(sums), dtype=bool)
    twice[1:] = (sums[by][1:] == sums[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    filled = np.maximum(np.bincount(line_doc, minlength=n)[:n], 1)
    doubled = np.bincount(line_doc[by][twice], minlength=n)[:n]

    words = np.maximum(count, 1)
    out = np.column_stack([
        np.log1p(count),
        np.log1p(solid / words),
        np.sqrt(share["upper"] / letters),
        np.sqrt(share["marks"] / some),
        np.sqrt(share["symbols"] / some),
        np.sqrt(share["digits"] / some),
        np.sqrt(share["bars"] / some),
        np.sqrt(share["wide"] / some),
        np.sqrt(np.bincount(doc, weights=same, minlength=n)[:n] / words),
        np.log1p(distinct) / np.maximum(np.log1p(count), 0.1),
        np.log1p(count / lines),
        np.sqrt(doubled / filled),
    ])
    out[count == 0] = 0
    return out


def with_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): one row per row of ``docs`` with its statistics; NULL counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array(x.ravel(), pa.float64())
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class shares, means and the inverses of the Cholesky factors of the two shrunk covariances."""

    log_share: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    limits: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1. Statistics are held within the range seen in training, and the log-density difference
        within bounds that keep it finite."""
        x = np.clip(x, *self.limits)
        density = [
            s - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d
            for s, m, w, d in zip(self.log_share, self.mean, self.whiten, self.log_det)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame, pooled: float = POOLED, round_: float = ROUND) -> Discriminant | float:
    """Fit on rows (x, label 0/1); with a class that has no rows, the smoothed share of class 1 instead."""
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    ends = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products, *ends).collect()
    by = {r["label"]: r for r in rows}
    n = np.array([by[k]["n"] if k in by else 0 for k in (0, 1)], dtype=float)
    if n.min() == 0:
        return float((n[1] + 0.5) / (n.sum() + 1))
    mean = np.array([[by[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / n[:, None]
    spread = np.array([[[by[k][f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)] for k in (0, 1)])
    own = spread / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    common = (own * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.diag(np.maximum(np.diag(common), 1e-6))
    whiten, log_det = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * own[k] + pooled * common + round_ * scale
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    limits = np.array([[f([by[k][f"{name}{i}"] for k in (0, 1)]) for i in range(d)] for name, f in (("lo", min), ("hi", max))])
    return Discriminant(np.log(n / n.sum()), mean, np.array(whiten), np.array(log_det), limits)


def scored(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """``stats`` (doc_id, x) with a column score; a table without both classes gives every row the same score."""
    if isinstance(model, float):
        return stats.select("doc_id", F.lit(model).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            score = pa.array(model.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def fold(id: str, folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds


def quality_scores(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality) may cover any part; rows of fold 0, NULL ids and labels other than 0 and 1 are not learnt
    from; an id with several labels counts with each. NULL and empty texts have all statistics zero and are scored like any.
    Repeated rows get equal scores each. Without labels of both classes all scores are the (smoothed) share of class 1. Other
    columns are not read.
    """
    stats = materialize(with_statistics(docs, id, text), "quality-statistics")
    learnt = labels.select(F.col(id).alias("doc_id"), F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id") != 0))
    model = fit(stats.join(learnt, "doc_id"))
    score = scored(stats, model)
    return score.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject.

    The model is fitted first, then the texts are scored where they are read; nothing but the labelled statistics is shuffled.
    """
    learnt = labels.select(F.col(id).alias("__id"), F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & (fold("__id") != 0))
    stats = materialize(with_statistics(docs, id, text), "quality-statistics")
    model = fit(stats.join(learnt, F.col("doc_id") == F.col("__id")))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(at))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
