"""Near duplicates by bottom-k sketches: the k smallest values of one hash function over a text's word shingles.

Inverted lists over retained values generate overlaps. Of two sets that are similar enough, the sketches share at least
``least`` values (exactly so for small sets, with probability ``recall`` for others), so any order of all values will do in
which every set enters the lists of its first ``size - least + 1`` values only. Rare values come first: a value that one set
alone retains takes a place and makes no list.

Pairs that meet are estimated by the sketch of their union, which is the k smallest values of both sketches, and what passes is
verified on the full sets. Equal sets form a class and take part once. A long list first meets its leader, in one row per
member; members that are linked with it need not meet each other any more. The others meet all members in units of two
blocks. Units return a forest of links, never pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelscout.llm.components import components
from modelscout.llm.jaccard_join import _forest, _intersections, ngram_sets
from modelscout.llm.words import mix
from modelscout.sources.scratch import materialize

WORDS = 2
PERCENT = 80  # of the union that two linked sets share, at least
KEPT = 32  # values of a sketch
RECALL = 0.9999  # that the sketches of a pair exactly at the threshold share enough values
BLOCK = 512  # sets of a list that meet in one unit, squared
GROUP_ROWS = 2048  # rows of units that share a group, about
GROUP_SHINGLES = 1 << 18  # shingles of texts that share a group when they are verified, about
LISTED_IDS = 1 << 20  # up to so many 8-byte ids are broadcast to pick texts before they are shuffled


def least_shared(kept: int, percent: int, recall: float) -> int:
    """How many of ``kept`` values of the union's sketch two sets share at least, with probability ``recall``, if they share ``percent``."""
    p, missed = percent / 100, 0.0
    for t in range(kept + 1):
        missed += math.comb(kept, t) * p**t * (1 - p) ** (kept - t)
        if missed > 1 - recall:
            return t
    return kept


def needed_overlap(size: Column, kept: int, percent: int, recall: float) -> Column:
    """Values that the sketch of a set shares with that of any similar set.

    A set so small that every similar one is whole in its sketch, too, shares its percentage for certain.
    """
    whole = F.ceil(size * percent / 100).cast("int")
    return F.when(size * 100 < kept * percent, whole).otherwise(F.lit(least_shared(kept, percent, recall)))


def sketches(docs: DataFrame, n: int, kept: int) -> DataFrame:
    """(id, row, size, set1, set2, sketch) of (id, row, text); the set is known by two sums over its shingles and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, cuts in ngram_sets(batch.column(2), n, lower=True):
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(m))) for m in (mix(sets + np.uint64(1)), mix(sets + np.uint64(2)))]
                one, two = (t[cuts[1:]] - t[cuts[:-1]] for t in total)
                sizes = np.diff(cuts)
                # shingles are hashes in ascending order within a text: the sketch is the front
                front = np.arange(len(sets)) - np.repeat(cuts[:-1], sizes) < kept
                at = np.concatenate(([0], np.cumsum(np.minimum(sizes, kept)))).astype(np.int32)
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes.astype(np.int64)),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(sets[front].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "size", "set1", "set2", "sketch"])

    return docs.mapInArrow(run, "id bigint, row bigint, size bigint, set1 bigint, set2 bigint, sketch array<bigint>")


KEY = ["size", "set1", "set2"]  # of a class of equal sets
UNIT = ["value", "i", "j"]


def inverted_lists(classes: DataFrame, kept: int, percent: int, recall: float) -> DataFrame:
    """(value, id, members) of every list a class enters, from classes (id, size, sketch); lists of one member are left out."""
    each = classes.select("id", "size", F.explode("sketch").alias("value"))
    counts = materialize(each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sketch-counts")
    shared = each.join(counts, "value").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("shared"))
    # values that nobody else retains come first in the order and are gone already
    places = F.size("shared") - needed_overlap(F.col("size"), kept, percent, recall) + 1
    first = shared.filter(places > 0).select("id", F.explode(F.slice("shared", 1, places)).alias("entry")).select("id", "entry.value")
    first = materialize(first, "sketch-entries")
    members = first.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("leader")).filter("members > 1")
    return materialize(first.join(materialize(members, "sketch-members"), "value"), "sketch-lists")


def union_matches(a: np.ndarray, b: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """(common values, values) of the union's sketch for every two rows of sketches, padded by the largest number."""
    end = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    again = np.zeros(both.shape, dtype=bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != end
    place = np.cumsum(real & ~again, axis=1)
    use = real & (place <= kept)
    return (use & again).sum(axis=1), np.minimum(place[:, -1], kept)


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(rows), width), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r.view(np.uint64)
    return out


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, kept: int, percent: int, least: int) -> np.ndarray:
    """Which pairs of sketches the estimate lets pass; sets that are whole in their sketches are decided."""
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 8192):
        at = slice(s, s + 8192)
        common, values = union_matches(a[at], b[at], kept)
        whole = np.maximum(size_a[at], size_b[at]) <= kept
        inter = np.where(whole, _common_of_whole(a[at], b[at]), 0)
        exact = 100 * inter >= percent * (size_a[at] + size_b[at] - inter)
        out[at] = np.where(whole, exact, (common >= least) | (values < kept))
    return out


def _common_of_whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    common, _ = union_matches(a, b, 2 * a.shape[1])
    return common


def _units(rows: pd.DataFrame) -> Iterator[tuple[int, int, int, slice]]:
    """(value, i, j, rows) of every unit in rows that are in the order of UNIT."""
    keys = rows[UNIT].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    for a, b in zip(starts, np.append(starts[1:], len(keys))):
        yield int(keys[a, 0]), int(keys[a, 1]), int(keys[a, 2]), slice(a, b)


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Common values of all pairs of rows."""
    return _intersections(sets) if any(len(s) for s in sets) else np.zeros((len(sets), len(sets)), dtype=np.float32)


def _open_pairs(value: int, i: int, j: int, roots: np.ndarray, blocks: np.ndarray, entered: list[np.ndarray]) -> np.ndarray:
    """Which pairs a unit answers for: not connected yet, of its two blocks, and in no list of a smaller value together."""
    n = len(roots)
    open_ = np.triu(np.ones((n, n), dtype=bool), 1) & (roots[:, None] != roots[None, :])
    if i != j:
        open_ &= blocks[:, None] != blocks[None, :]
    if open_.any():
        open_ &= _products([e[e < value] for e in entered]) == 0
    return open_


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) whose id is listed; a short list is broadcast so that other texts are not shuffled."""
    if ids.count() <= LISTED_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _sets(texts: pd.Series, n: int) -> list[np.ndarray]:
    """The full set of every text."""
    out: list[np.ndarray] = []
    for _, _, sets, cuts in ngram_sets(pa.array(texts, pa.large_string()), n, lower=True):
        out += [sets[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def leader_links(lists: DataFrame, classes: DataFrame, texts: DataFrame, n: int, kept: int, percent: int, recall: float, block: int) -> DataFrame:
    """Verified links (id, other) between the members of every list longer than ``block`` and its leader."""
    least = least_shared(kept, percent, recall)
    pairs = lists.filter(F.col("members") > block).select("id", "leader").filter("id <> leader").distinct()
    of_leader = classes.select(F.col("id").alias("leader"), F.col("size").alias("l_size"), F.col("sketch").alias("l_sketch"))
    met = pairs.join(classes.select("id", "size", "sketch"), "id").join(of_leader, "leader")
    met = met.filter(F.least("size", "l_size") * 100 >= F.greatest("size", "l_size") * percent)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a, b = (_padded(list(rows[c]), kept) for c in ("sketch", "l_sketch"))
            yield rows[_may_link(a, b, rows["size"].to_numpy(), rows["l_size"].to_numpy(), kept, percent, least)][["id", "leader"]]

    likely = materialize(met.mapInPandas(estimate, "id bigint, leader bigint"), "sketch-likely")
    # members come in parts, and the leader's text goes to every part
    parts = likely.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    parts = materialize(parts, "sketch-parts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = likely.join(parts, "leader").select("leader", part.alias("part"), "id")
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("id"))
    asked = rows.unionByName(heads)
    asked = asked.join(_texts_of(texts, asked.select("id").distinct()), "id")

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, sets = rows["id"].to_numpy(), _sets(rows["text"], n)
        head = sets[int(np.flatnonzero(ids == key[0])[0])]
        common = np.array([len(np.intersect1d(s, head, assume_unique=True)) for s in sets], dtype=np.int64)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        linked = (100 * common >= percent * (sizes + len(head) - common)) & (ids != key[0])
        return pd.DataFrame({"id": ids[linked], "other": np.full(int(linked.sum()), key[0], dtype=np.int64)})

    return asked.groupBy("leader", "part").applyInPandas(verify, "id bigint, other bigint")


def unit_links(
    lists: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, n: int, kept: int, percent: int, recall: float, block: int
) -> DataFrame:
    """A forest (id, other) of the verified links between members of a list that ``roots`` (node, root) do not connect yet."""
    least = least_shared(kept, percent, recall)
    entered = lists.groupBy("id").agg(F.collect_list("value").alias("entered"))
    known = classes.join(entered, "id").join(roots, F.col("id") == F.col("node"), "left")
    known = materialize(known.select("id", "size", "sketch", "entered", F.coalesce("root", "id").alias("root")), "sketch-known")
    labelled = lists.join(known.select("id", "root"), "id")
    of_leader = labelled.filter("id = leader").select("value", F.col("root").alias("main"))
    labelled = labelled.join(materialize(of_leader, "sketch-mains"), "value")
    outside = labelled.filter("root <> main").groupBy("value").agg(F.count(F.lit(1)).alias("outside"))
    labelled = labelled.join(materialize(outside, "sketch-outside"), "value")  # lists that are connected throughout go

    # those outside of the leader's component have the first blocks, and meet all blocks; the others meet only the first ones
    small = F.col("members") <= block
    n_out = F.when(small, 1).otherwise(F.ceil(F.col("outside") / block)).cast("int")
    n_in = F.when(small, 0).otherwise(F.ceil((F.col("members") - F.col("outside")) / block)).cast("int")
    spread = F.xxhash64("id")
    own = F.when(small, 0).when(F.col("root") != F.col("main"), F.pmod(spread, n_out)).otherwise(n_out + F.pmod(spread, F.greatest(n_in, F.lit(1))))
    labelled = labelled.withColumn("n_out", n_out).withColumn("n_all", n_out + n_in).withColumn("block", own.cast("int"))
    partners = F.when(F.col("block") < F.col("n_out"), F.col("n_all")).otherwise(F.col("n_out"))
    labelled = materialize(labelled.withColumn("partners", partners).select("value", "id", "block", "partners"), "sketch-blocks")
    copied = labelled.agg(F.sum("partners")).first()[0] or 0
    groups = max(1, math.ceil(copied / GROUP_ROWS))
    units = labelled.join(known, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partners") - 1)))
    units = units.select(
        "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "size", "sketch", "entered", "root", "block"
    ).withColumn("group", F.pmod(F.xxhash64(*UNIT), F.lit(groups)).cast("int"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*UNIT, "id"]).reset_index(drop=True)
        sizes, roots, blocks = (rows[c].to_numpy() for c in ("size", "root", "block"))
        sketch, lists = list(rows["sketch"]), list(rows["entered"])
        keep = np.zeros(len(rows), dtype=bool)
        for value, i, j, at in _units(rows):
            size = sizes[at]
            near = np.minimum(size[:, None], size[None, :]) * 100 >= percent * np.maximum(size[:, None], size[None, :])
            pairs = np.argwhere(_open_pairs(value, i, j, roots[at], blocks[at], lists[at]) & near)
            if len(pairs):
                padded = _padded(sketch[at], kept)
                a, b = pairs[:, 0], pairs[:, 1]
                pairs = pairs[_may_link(padded[a], padded[b], size[a], size[b], kept, percent, least)]
                keep[at.start + pairs.ravel()] = True
        return rows.loc[keep, [*UNIT, "id", "size", "entered", "root", "block"]]

    schema = "value bigint, i int, j int, id bigint, size bigint, entered array<bigint>, root bigint, block int"
    kept_rows = materialize(units.groupBy("group").applyInPandas(choose, schema), "sketch-units")
    shingles = kept_rows.agg(F.sum("size")).first()[0] or 0
    kept_rows = kept_rows.withColumn("group", F.pmod(F.xxhash64(*UNIT), F.lit(max(1, shingles // GROUP_SHINGLES))).cast("int"))
    asked = kept_rows.join(_texts_of(texts, kept_rows.select("id").distinct()), "id")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*UNIT, "id"]).reset_index(drop=True)
        ids, sizes, roots, blocks = (rows[c].to_numpy() for c in ("id", "size", "root", "block"))
        lists, texts = list(rows["entered"]), rows["text"]
        out: list[tuple[int, int]] = []
        for value, i, j, at in _units(rows):
            size, own = sizes[at], ids[at]
            common = _products(_sets(texts.iloc[at], n)).astype(np.int64)
            linked = _open_pairs(value, i, j, roots[at], blocks[at], lists[at])
            linked &= 100 * common >= percent * (size[:, None] + size[None, :] - common)
            out += [(own[a], own[b]) for a, b in _forest(np.argwhere(linked), len(own))]
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["id", "other"])

    return asked.groupBy("group").applyInPandas(verify, "id bigint, other bigint")


def sketch_duplicates(
    docs: DataFrame, n: int = WORDS, percent: int = PERCENT, kept: int = KEPT, recall: float = RECALL, id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``n`` consecutive words share at least ``percent`` of their union; A-Z count as
    a-z, words are runs of characters other than white space. A text of fewer words has one shingle, all its words.
    ``component_id`` is the smallest id that links lead to, the own included; the document with that id is kept. NULL, empty
    and blank texts have no shingles and are linked with nothing. Rows that repeat an id are decided each by its own text, but
    an id with several texts connects them. A row with a NULL id is linked with nothing and kept, with a NULL component. An empty table gives no
    rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.xxhash64(F.col(id), body)
    given = docs.select(F.col(id).cast("bigint").alias("id"), own.alias("row"), body.alias("text"))
    signed = materialize(sketches(given, n, kept), "sketch-signed")
    linked = signed.filter("size > 0 AND id IS NOT NULL")
    named = materialize(linked.groupBy(*KEY).agg(F.min("row").alias("class"), F.min("id").alias("rep")), "sketch-classes")
    carried = linked.withColumn("class", F.col("row")).join(named, [*KEY, "class"]).dropDuplicates(["class"])
    classes = materialize(carried.select(F.col("class").alias("id"), "size", "sketch"), "sketch-carriers")
    texts = given.filter("id IS NOT NULL").select(F.col("row").alias("id"), "text")

    lists = inverted_lists(classes, kept, percent, recall)
    stars = materialize(leader_links(lists, classes, texts, n, kept, percent, recall, block), "sketch-stars")
    roots = materialize(components(stars.select(F.col("id").alias("a"), F.col("other").alias("b"))), "sketch-roots")
    found = unit_links(lists, roots, classes, texts, n, kept, percent, recall, block)

    # an id with several texts connects their classes
    holders = linked.join(named, KEY).select("id", "class")
    spread = holders.groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("top")).filter("low < top")
    bridges = holders.join(spread, "id").select(F.col("class").alias("id"), F.col("low").alias("other"))
    links = stars.unionByName(found).unionByName(bridges)
    roots = materialize(components(links.select(F.col("id").alias("a"), F.col("other").alias("b"))), "sketch-components")
    tops = named.join(roots, F.col("class") == F.col("node"), "left").select(*KEY, "rep", F.coalesce("root", "class").alias("root"))
    lows = materialize(tops.groupBy("root").agg(F.min("rep").alias("low")), "sketch-lows")
    of_set = materialize(tops.join(lows, "root").select(*KEY, "low"), "sketch-of-set")
    out = signed.join(of_set, KEY, "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("low", "id")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op11_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, with the one of the smallest id marked to stay."""
    return sketch_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
