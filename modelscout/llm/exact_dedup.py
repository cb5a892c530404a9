"""Exact duplicates with the frequent ones split off: a Misra-Gries pass finds the digests that may be frequent, a second
pass counts them exactly and settles their winners, which are broadcast; all other digests take an ordinary shuffle.

At most ``counters`` digests are ever broadcast, whatever the table holds, and no digest that is left to the shuffle has
more than rows / (counters + 1) rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelscout.llm.names import free_names
from modelscout.sources.scratch import materialize

COUNTERS = 1024


def reduce_counters(counts: pd.Series, counters: int) -> pd.Series:
    """A Misra-Gries summary of at most ``counters`` entries: the next largest count is taken off every entry."""
    if len(counts) <= counters:
        return counts
    counts = counts.nlargest(counters + 1)
    counts = counts - counts.iloc[-1]
    return counts[counts > 0]


def frequent(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Every value of the column ``digest`` with more than rows / (counters + 1) rows, and possibly others.

    Each task keeps one summary. The summaries are added up, of which the largest ``counters + 1`` come back.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary = pd.Series(dtype="int64")
        for batch in batches:
            summary = reduce_counters(summary.add(batch["digest"].value_counts(), fill_value=0).astype("int64"), counters)
        yield pd.DataFrame({"digest": summary.index, "n": summary.to_numpy()})

    local = digests.select("digest").mapInPandas(summarise, "digest binary, n bigint")
    merged = local.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    rest = merged[counters]["n"] if len(merged) > counters else 0
    return [bytes(r["digest"]) for r in merged if r["n"] > rest]


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; NULL counts as the empty text. The row with the largest id stays. A NULL id
    is smaller than any other; where all ids of a group are NULL, its rows stay. Rows that repeat an id are counted each
    and stand or fall together. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    digests = docs.select(F.col(id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"))
    digests = materialize(digests, "exact-digests")
    candidates = frequent(digests, counters)
    marks = spark.createDataFrame([(d,) for d in candidates], "digest binary")
    hot = F.broadcast(
        digests.join(F.broadcast(marks), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    split = digests.join(hot, "digest", "left")
    others = digests.join(F.broadcast(marks), "digest", "left_anti")
    # written out, so that the rows of a group can be dealt to several tasks when they are joined back
    groups = materialize(others.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    rest = others.join(groups, "digest").select("digest", "doc_id", "keep_id", "group_size")
    every = split.filter("group_size IS NOT NULL").select("digest", "doc_id", "keep_id", "group_size").unionByName(rest)
    return every.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Copies of the frequent texts are left out before anything is shuffled; of the others the rows that go, known by id and
    digest, are anti-joined.
    """
    spark = docs.sparkSession
    own, its_sha, keep, lost, lost_sha = free_names(docs.columns, "own_sha", "sha", "keep", "gone", "gone_sha")
    found = materialize(exact_duplicates(docs, id, text, counters), "exact-decisions")
    top = found.groupBy("text_sha256", "keep_id").agg(F.max("group_size").alias("n")).filter("n > 1")
    winners = top.orderBy(F.desc("n"), "text_sha256").limit(counters).select("text_sha256", "keep_id").collect()
    hot = spark.createDataFrame([(r["text_sha256"], r["keep_id"]) for r in winners], f"{its_sha} string, {keep} bigint")
    sha: Column = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    marked = docs.withColumn(own, sha).join(F.broadcast(hot), F.col(own) == F.col(its_sha), "left")
    marked = marked.filter(F.col(its_sha).isNull() | F.col(id).eqNullSafe(F.col(keep))).drop(its_sha, keep)
    gone = found.filter("NOT kept").join(F.broadcast(hot.select(F.col(its_sha).alias("text_sha256"))), "text_sha256", "left_anti")
    gone = gone.select(F.col("doc_id").alias(lost), F.col("text_sha256").alias(lost_sha)).distinct()
    same = F.col(id).eqNullSafe(F.col(lost)) & (F.col(own) == F.col(lost_sha))
    return marked.join(gone, same, "left_anti").drop(own)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
