"""N-gram Jaccard join: texts whose sets of word n-grams have a similarity of at least a threshold.

MinHash signatures are cut into bands; texts that agree on a whole band meet in a bucket, and every pair that meets is
verified on the full sets of n-grams. The number of bands and of rows in a band follow from the wanted recall.

Texts with equal sets of n-grams form a class and take part once. A bucket of any size is searched in units of two blocks,
and a unit returns counts and a forest of its links, one row per text at most, never its pairs. A pair that meets in
several bands is verified in the first of them only, and a text goes to a unit only if it has such a pair there.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelscout.llm.components import components
from modelscout.llm.names import free_names
from modelscout.llm.words import mix, shingles, words
from modelscout.sources.scratch import materialize

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995  # of a pair exactly at the threshold; more similar pairs have more
MAX_HASHES = 128
BLOCK = 512  # texts of a bucket that meet in one unit, squared
GROUP_ROWS = 2048  # rows of units that share a group, about
SEED = 0xA0761D6478BD642F


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands, so the fewest pairs to verify, that reach ``recall`` within ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _signature(sets: np.ndarray, cuts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band for every text; ``sets`` has the distinct n-grams text by text."""
    full = np.flatnonzero(np.diff(cuts) > 0)
    out = np.zeros((len(cuts) - 1, bands), dtype=np.uint64)
    if not len(full):
        return out
    starts = cuts[:-1][full]
    factors = mix(np.arange(bands * rows, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)
    for b in range(bands):
        total = np.full(len(full), b + 1, dtype=np.uint64)
        for f in factors[b * rows : (b + 1) * rows]:
            x = (sets ^ (f >> np.uint64(7))) * f
            x ^= x >> np.uint64(32)
            total = mix(total ^ np.minimum.reduceat(x, starts)) + f
        out[full, b] = total
    return out


def _distinct(sh: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of every text, in order, and where each text's begin."""
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(cuts)))


def ngram_sets(texts: pa.Array, n: int, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, distinct n-grams, where each text's begin) for slices of texts."""
    for a, b, w, cuts in words(texts, lower):
        yield (a, b, *_distinct(*shingles(w, cuts, n)))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, row, size, set1, set2, bands) of (id, row, text); the set is known by two sums over its n-grams and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, cuts in ngram_sets(batch.column(2), n):
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(m))) for m in (mix(sets + np.uint64(1)), mix(sets + np.uint64(2)))]
                one, two = (t[cuts[1:]] - t[cuts[:-1]] for t in total)
                sig = _signature(sets, cuts, bands, rows).view(np.int64)
                at = pa.array(np.arange(0, sig.size + 1, bands, dtype=np.int32))
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(sig.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "size", "set1", "set2", "bands"])

    return docs.mapInArrow(run, "id bigint, row bigint, size bigint, set1 bigint, set2 bigint, bands array<bigint>")


KEY = ["size", "set1", "set2"]  # of a class of equal sets
UNIT = ["band", "hash", "i", "j"]


def _units(rows: pd.DataFrame) -> Iterator[tuple[int, int, int, slice]]:
    """(band, i, j, rows) of every unit in rows that are in the order of UNIT."""
    keys = rows[UNIT].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    for a, b in zip(starts, np.append(starts[1:], len(keys))):
        yield int(keys[a, 0]), int(keys[a, 2]), int(keys[a, 3]), slice(a, b)


def _fresh(b: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows of the band hashes ``b`` meet in ``band`` and in no band before it."""
    met = np.zeros((len(b), len(b)), dtype=bool)
    for k in range(band):
        met |= b[:, k][:, None] == b[:, k][None, :]
    return ~met & (b[:, band][:, None] == b[:, band][None, :])


def _wanted(block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of texts a unit answers for: one of each block; each pair once."""
    n = len(block)
    upper = np.triu(np.ones((n, n), dtype=bool), 1)
    if i == j:
        return upper
    return upper & (block[:, None] != block[None, :])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of all pairs, by a product of 0/1 matrices over the n-grams that at least two texts have."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (c, c + width))
        part = np.zeros((n, min(width, int(shared.sum()) - c)), dtype=np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        out += part @ part.T
    return out


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what ``pairs`` connects, fewer than ``n``."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def similar_classes(classes: DataFrame, texts: DataFrame, n: int, similarity: float, block: int) -> DataFrame:
    """(id, other, links): counts of similar documents and links of a forest, from classes (id, size, n_docs, bands) and the
    texts (id, text) of their representatives; ``other`` is NULL in rows that only count."""
    each = classes.select("id", F.posexplode("bands").alias("band", "hash"))
    counts = each.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = materialize(each.join(counts, ["band", "hash"]), "jaccard-met")
    # the band hashes are joined only to texts that met another
    candidates = classes.join(met.select("id").distinct(), "id").select("id", "size", "n_docs", "bands")
    members = met.join(candidates, "id").withColumn("n_blocks", F.ceil(F.col("members") / block).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    units = members.select("band", "hash", "id", "size", "n_docs", "bands", "block", other)
    # a unit is small; many of them share a group so that a group is worth its start; a row counts once for every unit it goes to
    copied = met.agg(F.sum(F.ceil(F.col("members") / block))).first()[0] or 0
    groups = max(1, math.ceil(copied / GROUP_ROWS))
    units = units.select(
        "band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "size", "n_docs", "bands", "block"
    ).withColumn("group", F.pmod(F.xxhash64(*UNIT), F.lit(groups)).cast("int"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*UNIT, "id"])
        all_bands, sizes, blocks = np.stack(rows["bands"].to_numpy()), rows["size"].to_numpy(), rows["block"].to_numpy()
        keep = np.zeros(len(rows), dtype=bool)
        for band, i, j, at in _units(rows):
            size = sizes[at]
            # sets of very different sizes cannot be similar
            near = np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-9
            fresh = _fresh(all_bands[at], band) & _wanted(blocks[at], i, j) & near
            keep[at] = fresh.any(axis=0) | fresh.any(axis=1)
        return rows[keep]

    kept = materialize(units.groupBy("group").applyInPandas(choose, units.schema), "jaccard-units")
    needed = texts.join(kept.select("id").distinct(), "id").select("id", "text").dropDuplicates(["id"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, cuts in ngram_sets(batch.column(1), n):
                grams = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), grams], names=["id", "grams"])

    sets = needed.mapInArrow(sets_of, "id bigint, grams array<bigint>")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*UNIT, "id"])
        ids, sizes, docs, blocks = (rows[c].to_numpy() for c in ("id", "size", "n_docs", "block"))
        grams, all_bands = rows["grams"].to_numpy(), np.stack(rows["bands"].to_numpy())
        out = []
        for band, i, j, at in _units(rows):
            size, own = sizes[at], ids[at]
            common = _intersections(list(grams[at]))
            fresh = _fresh(all_bands[at], band) & _wanted(blocks[at], i, j)
            similar = fresh & (common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9)
            if not similar.any():
                continue
            count = similar @ docs[at] + similar.T @ docs[at]
            out += [(own[k], None, count[k]) for k in np.flatnonzero(count)]
            out += [(own[a], own[b], 0) for a, b in _forest(np.argwhere(similar), len(own))]
        # ids use all 64 bits: no detour over floating point for the missing ones
        id, other, links = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"id": np.array(id, dtype=np.int64), "other": pd.array(other, dtype="Int64"), "links": np.array(links, dtype=np.int64)})

    return kept.join(sets, "id").groupBy("group").applyInPandas(verify, "id bigint, other bigint, links bigint")


def _row(id: str, text: str) -> Column:
    """The number of a row's id and text together."""
    return F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit("")))


def _linked(
    docs: DataFrame, n: int, similarity: float, recall: float, id: str, text: str, block: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, row, KEY, bands) with words; members (KEY, id, row); classes of equal sets (KEY, class, rep, n_docs), of which
    ``rep`` is the smallest id; and what :func:`similar_classes` finds among the classes."""
    bands, rows = bands_for(similarity, recall)
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), _row(id, text).alias("row"), body.alias("text"))
    signed = materialize(signatures(given, n, bands, rows).filter("size > 0"), "jaccard-signatures")
    members = signed.groupBy(*KEY, "id").agg(F.min("row").alias("row"))
    named = members.groupBy(*KEY).agg(F.min("row").alias("class"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_docs"))
    named = materialize(named, "jaccard-classes")
    carried = signed.withColumn("class", F.col("row")).join(named, [*KEY, "class"]).dropDuplicates(["class"])
    classes = materialize(carried.select(F.col("class").alias("id"), "size", "n_docs", "bands"), "jaccard-carriers")
    texts = given.select(F.col("row").alias("id"), "text")
    return signed, members, named, materialize(similar_classes(classes, texts, n, similarity, block), "jaccard-found")


def jaccard_join(
    docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    Two documents are linked if their sets of ``n`` consecutive words have a Jaccard similarity of at least ``similarity``; words
    are runs of characters other than white space. A text of fewer words has one n-gram, all its words. ``n_links`` counts
    the linked documents, copies included; ``class_id`` is the smallest id among all that links connect. Texts without words
    and NULLs have no links and are classes of their own. Rows that repeat an id and a set count once; an id with several sets
    is linked through each of them (its links add up, its classes run together). Rows with a NULL id have NULL as class and no
    links. An empty table gives no rows. Other columns are not read.
    """
    signed, members, named, found = _linked(docs, n, similarity, recall, id, text, block)
    rep = named.select("class", "rep")
    count = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("others"))
    joined = found.filter("other IS NOT NULL").join(rep.withColumnRenamed("rep", "a"), F.col("id") == F.col("class")).select("a", "other")
    links = joined.join(rep.withColumnRenamed("rep", "b"), F.col("other") == F.col("class")).select("a", "b")
    # an id that stands in several classes connects them
    shared = members.join(named, KEY).select("id", "class", "rep")
    spread = shared.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).filter("low < top").select("id")
    bridges = shared.join(spread, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(bridges))

    of_class = named.join(count, "class", "left").join(roots, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("class", F.coalesce("root", "rep").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # written out, so that the rows of a class with very many copies can be dealt to several tasks
    of_class = materialize(of_class, "jaccard-of-class")
    per_id = shared.join(of_class, "class").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
    asked = docs.select(F.col(id).alias("doc_id"))
    return asked.join(per_id, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("class_id", F.col("doc_id").cast("bigint")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def without_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest among all texts that links connect with their own.

    Links are those of :func:`jaccard_join`, but every row goes by its own text: an id with several texts does not connect them,
    and may stay with one and go with another. Rows without words or with a NULL id stay.
    """
    lost, lost_row = free_names(docs.columns, "gone", "gone_row")
    signed, _, named, found = _linked(docs, n, similarity, RECALL, id, text, BLOCK)
    # nodes are classes and not ids, so that an id with several texts is no bridge
    roots = materialize(components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "jaccard-roots")
    reps = materialize(roots.join(named, F.col("node") == F.col("class")).select("root", "class", "rep"), "jaccard-reps")
    low = reps.groupBy("root").agg(F.min("rep").alias("low"))
    lows = materialize(reps.join(low, "root").select("class", "low"), "jaccard-lows")
    of_class = materialize(named.join(lows, "class", "left").select(*KEY, F.coalesce("low", "rep").alias("low")), "jaccard-lowest")
    gone = signed.join(of_class, KEY).filter("id <> low").select(F.col("id").alias(lost), F.col("row").alias(lost_row)).distinct()
    return docs.join(gone, (F.col(id) == F.col(lost)) & (_row(id, text) == F.col(lost_row)), "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
