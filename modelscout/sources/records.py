"""Text records with quoted line breaks, read by many tasks.

Spark's text reader deals a file out in byte ranges that begin at a line, but whether that line begins a record or goes on inside a
quoted field depends on all that stands before it. A first scan therefore works out, range by range, where each of these
two states leads; going through the ranges of a file in order, of which there are as many as the scan has splits, settles the
state at the beginning of each. With it, every range yields whole records on its own. What is cut by the end of a range is put
together with the beginning of the next by a shuffle of at most two pieces a range.

A quote opens a field only where the field begins, two quotes within a quoted field are one of its characters, and a field that goes on
after its closing quote ends at the next separator.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from modelscout.sources.scratch import materialize

REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"')  # of a quoted field, with its closing quote
WHOLE, TAIL, THROUGH, HEAD = range(4)  # a record, or the piece that a range has of one: its beginning, middle or end
COLUMN_NAMES = -1  # stands for the place of a file's first record where it is cut


def stays_open(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or at the beginning of a record."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(sep + '"') + len(sep) + 1
            if at == len(sep):
                return False
    while True:
        end = REST.match(line, at)
        if end is None:
            return True
        at = line.find(sep + '"', end.end()) + len(sep) + 1
        if at == len(sep):
            return False


@dataclass(frozen=True)
class Ranges:
    """Every range of the scan: a key made of file, place and length, whether it begins inside a quoted field, and the same of its end."""

    key: np.ndarray
    inside: np.ndarray
    plain: bool  # every line is a record, whichever way lines are told apart
    split: bool  # some file has more than one range

    def begins_inside(self, key: int) -> bool:
        at = int(np.searchsorted(self.key, key))
        if at == len(self.key) or self.key[at] != key:
            raise RuntimeError("the files were dealt out in other ranges than when they were looked through; read them again")
        return bool(self.inside[at])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, key, value): the lines of all files, in order within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    path_, start, length = (F.col(f"_metadata.{n}") for n in ("file_path", "file_block_start", "file_block_length"))
    return lines.select(F.xxhash64(path_).alias("file"), start.alias("start"), F.xxhash64(path_, start, length).alias("key"), "value")


def _in_ranges(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(file, start, key, rest of the columns) of the runs of one range in a batch."""
    key = batch.column(2).to_numpy()
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), int(key[a]), *(c.slice(a, b - a) for c in batch.columns[3:])


def find_ranges(spark: SparkSession, path: str, sep: str) -> Ranges:
    """Go through all files once. Lines without a quote leave the state as it is and are not sent to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # where the two states at the beginning lead, and whether a line of several in a record was met on the way
        found: dict[int, list] = {}
        for batch in batches:
            for file, start, key, lines, odd in _in_ranges(batch):
                own = found.setdefault(key, [file, start, key, False, True, False, False, False])
                own[7] |= bool(pc.any(odd).as_py())
                for line in lines.drop_null().to_pylist():
                    after = {state: stays_open(line, state, sep) for state in {own[3], own[4]}}
                    for state in (3, 4):
                        own[state + 2] |= own[state] or after[own[state]]
                        own[state] = after[own[state]]
        rows = list(found.values())
        types = [pa.int64()] * 3 + [pa.bool_()] * 5
        names = ["file", "start", "key", "from_out", "from_in", "many_out", "many_in", "odd"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    # where Spark's own reader of single lines would see more lines, or fewer
    odd = F.contains("value", F.lit("\r")) | ((F.trim("value") == "") & (F.col("value") != ""))
    scan = _lines(spark, path).select("file", "start", "key", quoted.alias("value"), odd.alias("odd"))
    # one row for every split of the scan, of which the driver keeps track in any case
    flags = ", ".join(f"{n} boolean" for n in ("from_out", "from_in", "many_out", "many_in", "odd"))
    rows = scan.mapInArrow(run, f"file bigint, start bigint, key bigint, {flags}").collect()
    rows.sort(key=lambda r: (r["file"], r["start"]))
    keys, inside, many, file, state = [], [], False, None, False
    for r in rows:
        state = state if r["file"] == file else False
        file = r["file"]
        keys.append(r["key"])
        inside.append(state)
        many |= r["many_in"] if state else r["many_out"]
        state = r["from_in"] if state else r["from_out"]
    order = np.argsort(np.array(keys, dtype=np.int64))
    files = {r["file"] for r in rows}
    plain = not many and not any(r["odd"] for r in rows)
    return Ranges(np.array(keys, dtype=np.int64)[order], np.array(inside, dtype=bool)[order], plain, len(rows) > len(files))


def records(spark: SparkSession, path: str, sep: str, ranges: Ranges) -> DataFrame:
    """(text): every record of all files but the first of each, which names the columns. Blank lines are no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        held: list[str] = []  # lines of the record that is open
        inside = begun_before = names = False  # within it, it began in an earlier range, it is the first of its file

        def piece(last: bool) -> tuple:
            kind = (HEAD if last else THROUGH) if begun_before else (WHOLE if last else TAIL)
            return at[0], COLUMN_NAMES if names and kind == TAIL else at[1], kind, "\n".join(held)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["file", "start", "kind", "text"])

        for batch in batches:
            out: list[tuple] = []
            for file, start, key, lines in _in_ranges(batch):
                if at != (file, start, key):
                    if inside:
                        out.append(piece(False))
                    at, held, names = (file, start, key), [], start == 0
                    inside = begun_before = ranges.begins_inside(key)
                for line in lines.to_pylist():
                    if not inside and line in ("", "\r"):
                        continue
                    held.append(line)
                    if '"' in line:
                        inside = stays_open(line, inside, sep)
                    if not inside:
                        if not names:
                            out.append(piece(True))
                        held, begun_before, names = [], False, False
            yield rows(out)
        if inside:
            yield rows([piece(False)])

    found = _lines(spark, path).mapInArrow(run, "file bigint, start bigint, kind int, text string")
    # at most two a range; the end of a record stands before the beginning of the next one
    pieces = materialize(found.filter(F.col("kind") != WHOLE), "record-pieces")
    keys = ["file", "start", "kind"]
    in_order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    numbered = pieces.select(*keys, F.count_if(F.col("kind") == TAIL).over(in_order).alias("number"))
    place = F.struct("start", (-F.col("kind")).alias("back"), "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "\n")
    joined = pieces.join(numbered, keys).groupBy("file", "number").agg(text.alias("text"), F.min("start").alias("start"))
    cut = joined.filter(F.col("start") != COLUMN_NAMES).select("text")
    return found.filter(F.col("kind") == WHOLE).select("text").unionByName(cut)


def read_records(
    spark: SparkSession, path: str, columns: list[str], schema: T.StructType | None, options: dict[str, str | bool], ranges: Ranges
) -> DataFrame:
    """The records as a table with these columns, all of them text unless there is a ``schema``."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    # lines end as the first one does
    text = F.regexp_replace("text", "\r$", "") if first is not None and first[0].endswith("\r") else F.col("text")
    rows = records(spark, path, str(options["sep"]), ranges).select(text.alias("text"))
    kinds = [f.dataType for f in schema.fields] if schema else [T.StringType()] * len(columns)
    wanted = ", ".join(f"c{k} {kind.simpleString()}" for k, kind in enumerate(kinds))
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    parsed = rows.select(F.from_csv("text", wanted, given).alias("r"))
    return parsed.select([F.col(f"r.c{k}").alias(name) for k, name in enumerate(columns)])
