"""The corpus pipeline: stages over documents, each of which takes what the one before it kept.

The first four stages keep rows of documents with all their columns, whatever these are called; the last one encodes what is
left and decodes it again.

NULL texts count as empty ones: they are scored with all statistics zero, are copies of each other and of empty texts, are
linked with nothing, have no tokens and no pieces. Blank texts are like them but for being equal only to themselves. Texts
of any length are gone through whole. Rows with a NULL id stay in the exact stage only if no row with an id has their text, and
are never dropped as near copies; they share one draw when sources are mixed. Rows that repeat an id are judged each by their own text;
rows equal in id and text stand or fall together. Ties go to the largest id among equal texts and to the smallest id among
near ones. An empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelscout.llm.exact_dedup import without_duplicates
from modelscout.llm.jaccard_join import without_similar
from modelscout.llm.mixing import mixed_documents
from modelscout.llm.pieces import round_trip
from modelscout.llm.quality import good_documents
from modelscout.sources.scratch import remove, scratch, scratch_path

MIX_SHARE = 0.9  # of the tokens that are left; a document is taken once at most


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return without_duplicates(docs)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of Jaccard similarity connect, the document with the smallest id."""
    return without_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights of domains, languages and sources."""
    return mixed_documents(docs, share=MIX_SHARE, epochs=1)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) of every document; the last is the digest of the text that the ids decode to."""
    return round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", similar_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]
# A classifier's scores, links found by hashing and encodings have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; every stage's result is written once and read again by the next.

    A stage's own intermediate tables are deleted when its result is written, and its input when the next result is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-stage")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
