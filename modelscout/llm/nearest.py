"""Approximate nearest neighbours by cosine: inverted lists whose vectors are scanned dimension by dimension.

Vectors are divided among lists around centres fitted on a bounded sample. Within a list they are rotated at random and
laid out in column blocks. A query adds up squared distances block by block; since a rotated vector spreads its length over
all dimensions, the part of a distance seen so far estimates the whole, and a candidate is abandoned as soon as a test
says that it is hardly among the nearest. What is left is scored exactly on the original vectors.

Copies of a vector are searched once: only the ``k + 1`` smallest ids of a vector can be among the nearest of anything.
Lists are searched in blocks of vectors and of queries, so that no group grows with the table.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from modelscout.sources.scratch import materialize

K = 5
ROWS_PER_LIST = 1024
RECALL = 0.95  # aimed at, by brute force on the sample; how many lists that takes depends on the vectors
SAMPLE_ROWS = 20_000  # rows that the centres and the number of probes are fitted on; every row is indexed
TRIAL_QUERIES = 400
MAX_LISTS = 2048  # centres sent to the tasks; beyond it lists grow and are searched in more blocks
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
COLUMN_BLOCKS = 4
DOUBT = 2.1  # of the test: larger abandons later


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no NULL, NaN or infinite component, and one that is not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, so that no square overflows; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``x`` with ``q`` in double precision; equal rows have equal values."""
    x, q = scaled(x), scaled(q[None])[0]
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt((q * q).sum()))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres(sample: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def probes_for(sample: np.ndarray, centre: np.ndarray, k: int, recall: float) -> int:
    """How many of the lists nearest to a query hold ``recall`` of its ``k`` nearest, over trial queries of the sample."""
    step = max(1, len(sample) // TRIAL_QUERIES)
    q = np.arange(0, len(sample), step)
    near = sample[q] @ sample.T
    near[np.arange(len(q)), q] = -2
    top = np.argpartition(-near, min(k, len(sample) - 1), axis=1)[:, :k]
    own = np.argmax(sample @ centre.T, axis=1)
    order = np.argsort(-(sample[q] @ centre.T), axis=1)
    rank = np.argsort(order, axis=1)[np.arange(len(q))[:, None], own[top]]
    return int(np.quantile(rank, recall, method="higher")) + 1


def scan(x: np.ndarray, rotated: list[np.ndarray], q: np.ndarray, most: int, doubt: float = DOUBT) -> np.ndarray:
    """Rows whose distance to the rotated query ``q`` survives; ``rotated`` has the rows' column blocks.

    The first rows are measured whole and give the first bound; the others meet it block by block.
    """
    n, dim = len(x), len(q)
    edges = np.cumsum([0] + [b.shape[1] for b in rotated])
    bound, found, kept = np.inf, np.zeros(0), np.zeros(0, dtype=np.int64)
    at, step = 0, max(64, most)
    while at < n:
        alive = np.arange(at, min(at + step, n))
        so_far = np.zeros(len(alive), dtype=np.float32)
        for b, block in enumerate(rotated):
            part = block[alive] - q[edges[b] : edges[b + 1]]
            so_far += np.einsum("ij,ij->i", part, part)
            seen = edges[b + 1]
            limit = bound * (1 + doubt / math.sqrt(seen)) ** 2 * seen / dim if seen < dim else bound
            stay = so_far <= limit + 1e-5
            alive, so_far = alive[stay], so_far[stay]
            if not len(alive):
                break
        kept, found = np.concatenate([kept, alive]), np.concatenate([found, so_far])
        if len(found) >= most:
            bound = np.partition(found, most - 1)[most - 1]
            stay = found <= bound + 1e-5
            kept, found = kept[stay], found[stay]
        at, step = at + step, 1024
    return kept


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding",
    rows_per_list: int = ROWS_PER_LIST, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of ``vectors`` for every row of ``queries`` but itself.

    Ranks follow the cosine, ties the smaller id; all rows come back where there are no more than ``k``. Rows without id, and
    vectors that are NULL, zero, have NULL or non-finite components or another length than most vectors, take no part on either side.
    Ids are expected once: a repeated id with one vector counts once, with several vectors once for each. Empty tables give
    no rows. Other columns are not read. As many lists are probed as hold ``recall`` of the neighbours in the sample; vectors
    without any structure need most lists, clustered ones few.
    """
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(id).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))

    rows, asked = clean(vectors), clean(queries)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    dim, n = lengths["dim"], lengths["n"]
    mark = F.xxhash64("v").alias("mark")  # equal vectors meet by hash and by value
    smallest = Window.partitionBy("mark", "v").orderBy("vec_id")
    # -0.0 and 0.0 are one value
    rows = rows.filter(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select("vec_id", "v", mark)
    asked = asked.filter(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select("vec_id", "v", mark)
    rows = rows.dropDuplicates(["mark", "v", "vec_id"]).withColumn("copy", F.row_number().over(smallest)).filter(F.col("copy") <= k + 1)

    sample = rows.filter("copy = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    base = unit(sample.flatten().to_numpy().reshape(-1, dim))
    lists = max(1, min(math.ceil(n / rows_per_list), max_lists, len(base)))
    centre = centres(base, lists, seed)
    probes = probes_for(base, centre, k, recall) if lists > 1 else 1
    turn = rotation(dim, seed)

    def assign(batches):
        for batch in batches:
            x = unit(matrix(batch["v"]))
            yield pd.DataFrame({"list": np.argmax(x @ centre.T, axis=1).astype(np.int32), "vec_id": batch["vec_id"], "v": batch["v"]})

    indexed = materialize(rows.select("vec_id", "v").mapInPandas(assign, "list int, vec_id bigint, v array<double>"), "nearest-lists")
    size = np.zeros(lists, dtype=np.int64)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["list"]] = r["n"]

    def probe(batches):
        for batch in batches:
            order = np.argsort(-(unit(matrix(batch["v"])) @ centre.T), axis=1, kind="stable")
            rows_before = np.cumsum(size[order], axis=1) - size[order]
            wanted = (np.arange(lists) < probes) | (rows_before <= k + 1)  # more lists where these hold too few rows
            q, place = np.nonzero(wanted)
            yield pd.DataFrame({"list": order[q, place].astype(np.int32), "mark": batch["mark"].to_numpy()[q], "query": batch["query"].to_numpy()[q], "v": batch["v"].to_numpy()[q]})

    # one search for all queries with the same vector; its smallest id stands for it
    own = Window.partitionBy("mark", "v")
    asked = asked.dropDuplicates(["mark", "v", "vec_id"])
    distinct = asked.groupBy("mark", "v").agg(F.min("vec_id").alias("query"))
    probing = materialize(distinct.mapInPandas(probe, "list int, mark bigint, query bigint, v array<double>"), "nearest-probes")
    counts = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qs"))
    shape = counts.join(indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("vs")), "list")
    shape = F.broadcast(shape)  # at most max_lists rows

    def dealt(df: DataFrame, key: str, here: str, there: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(here)).cast("int").alias(here[0] + "b")
        return df.join(shape, "list").select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(there) - 1)).alias(there[0] + "b"))

    left = dealt(indexed, "vec_id", "vs", "qs").groupBy("list", "vb", "qb")
    right = dealt(probing.select("list", "query", "v"), "query", "qs", "vs").groupBy("list", "vb", "qb")

    def search(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        vs = vs.sort_values("vec_id")
        x, ids = matrix(vs["v"]), vs["vec_id"].to_numpy()
        whole = unit(x).astype(np.float32) @ turn
        blocks = [np.ascontiguousarray(b) for b in np.array_split(whole, min(COLUMN_BLOCKS, whole.shape[1]), axis=1)]
        out = []
        for name, q in zip(qs["query"], matrix(qs["v"])):
            kept = scan(x, blocks, unit(q[None])[0].astype(np.float32) @ turn, k + 1)
            score = cosines(x[kept], q)
            best = np.lexsort((ids[kept], -score))[: k + 1]
            out.append(pd.DataFrame({"query": name, "vec_id": ids[kept][best], "score": score[best]}))
        return pd.concat(out)

    found = left.cogroup(right).applyInPandas(search, "query bigint, vec_id bigint, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1)
    members = asked.select(F.col("vec_id").alias("query_id"), F.min("vec_id").over(own).alias("query"))
    each = members.join(found, "query").filter("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
