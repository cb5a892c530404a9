"""Fill-in-the-middle transformation: a text is cut at two of its line boundaries and its parts are put in another order.

Where line k ends is read from a learned rank index: straight segments over (number of lines, offset) that miss no boundary by
more than ERROR characters, and for every boundary by how much. A cut is predicted from its segment and made exact by what is
stored. Slopes are whole numbers of 1 / 2**SHIFT characters a line, so that fit and prediction round alike. The index is
fitted in numpy, a batch of texts at a time; cutting, joining and restoring are expressions.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelscout.llm.words import bytes_of, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # of a hundred texts that are transformed, the others stay plain
SPM = 50  # of a hundred transformed texts that begin with the suffix
ERROR = 1024  # characters by which a prediction may be off; what is stored fits into 16 bits
SHIFT = 16
LONGEST = 1 << 16  # lines of a segment, so that rounding its slope costs less than one character
FIRST_LOOK = 64  # lines that are tried at once; four times as many as long as they fit
INDEX = "struct<n: bigint, segments: array<struct<rank: bigint, offset: bigint, slope: bigint>>, residuals: array<smallint>>"


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> list[tuple[int, int, int]]:
    """(rank, offset, slope) of segments that begin at a boundary each and miss none of theirs by more than ``error``.

    A segment goes on as long as a line through its first boundary stays near enough to all that follow; ``error`` is 3 at least.
    """
    out, start, end = [], 0, len(offsets)
    while start < end:
        look = FIRST_LOOK
        while True:
            stop = min(start + 1 + look, end)
            steps = np.arange(1, stop - start)
            rise = offsets[start + 1 : stop] - offsets[start]
            low = np.maximum.accumulate((rise - (error - 2)) / steps)
            high = np.minimum.accumulate((rise + (error - 2)) / steps)
            fits = int(np.searchsorted(low > high, True))  # False for all that fit, then True
            if fits < len(steps) or stop == end or look >= LONGEST:
                break
            look *= 4
        slope = round((low[fits - 1] + high[fits - 1]) / 2 * 2**SHIFT) if fits else 0
        out.append((start, int(offsets[start]), slope))
        start += fits + 1
    return out


def predict(segments: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Offsets of boundaries by the segments alone."""
    own = segments[np.searchsorted(segments[:, 0], ranks, side="right") - 1]
    return own[:, 1] + ((ranks - own[:, 0]) * own[:, 2] >> SHIFT)


def line_offsets(data: np.ndarray) -> np.ndarray:
    """0 and the end of every line of a UTF-8 text, in code points; a last line needs no line feed."""
    ends = np.flatnonzero(data == 0x0A) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    ends = np.concatenate(([0], ends))
    begins = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)  # code points that begin up to a byte
    return np.concatenate(([0], begins))[ends]


def _lists(rows: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), values)


def rank_index(text: Column) -> Column:
    """The learned index of a text's line boundaries: its number of lines, segments and residuals; NULL counts as empty."""

    def build(texts: pa.Array) -> pa.Array:
        data, bounds = bytes_of(texts)
        counts, segments, residuals = [], [], []
        for a, b in slices(bounds):
            for i in range(a, b):
                offsets = line_offsets(data[bounds[i] : bounds[i + 1]])
                own = np.array(fit_segments(offsets), dtype=np.int64)
                counts.append(len(offsets) - 1)
                segments.append(own)
                residuals.append((offsets - predict(own, np.arange(len(offsets)))).astype(np.int16))
        flat = np.concatenate(segments) if segments else np.zeros((0, 3), dtype=np.int64)
        parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["rank", "offset", "slope"])
        small = pa.array(np.concatenate(residuals) if residuals else np.zeros(0, np.int16))
        columns = [pa.array(counts, pa.int64()), _lists(segments, parts), _lists(residuals, small)]
        return pa.StructArray.from_arrays(columns, names=["n", "segments", "residuals"])

    build.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(build, INDEX)(text)


def boundary(index: Column, rank: Column) -> Column:
    """Where line ``rank`` ends, in code points from the front: the prediction and what it misses."""
    segment = F.element_at(F.filter(index["segments"], lambda s: s["rank"] <= rank), -1)
    predicted = segment["offset"] + F.shiftright((rank - segment["rank"]) * segment["slope"], SHIFT)
    return predicted + F.element_at(index["residuals"], (rank + 1).cast("int"))


def draws(id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits that follow from an id and the seed; a NULL id draws as one without digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("bigint").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def line_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, segments, residuals): the index of every row's text, which can be stored apart from the texts."""
    found = docs.select(F.col(id).cast("bigint").alias("doc_id"), rank_index(F.col(text)).alias("index"))
    return found.select("doc_id", "index.n", "index.segments", "index.residuals")


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars, output (the transformed text).

    The two cuts are line boundaries drawn from id and seed; equal ones give an empty middle. ``form`` is psm (prefix, suffix, middle) or
    spm (suffix, prefix, middle), or plain: of a text that is NULL or empty or holds one of the three markers, and of those
    that ``rate`` leaves out. A plain output is the text itself, and its lengths are NULL. Rows that repeat an id have the
    same draws, so equal rows give equal outputs; NULL ids share one draw. A text without line feeds is one line. An empty table
    gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("index", rank_index(F.col("text"))).withColumn("n", F.col("index.n"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("n") == 0) | marked[0] | marked[1] | marked[2] | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumn("form", form)
    rows = rows.withColumn("first", boundary(F.col("index"), F.least(one, two)).cast("int"))
    rows = rows.withColumn("second", boundary(F.col("index"), F.greatest(one, two)).cast("int"))
    prefix = F.substring("text", F.lit(1), F.col("first"))
    middle = F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring("text", F.col("second") + 1, F.length("text"))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(cut, F.col("first").cast("bigint")).alias("prefix_chars"),
        F.when(cut, (F.col("second") - F.col("first")).cast("bigint")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is in a transformed text, and none can arise where parts meet."""
    first = F.when(form == "psm", PREFIX).otherwise(SUFFIX)
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substring(output, F.length(first) + 1, F.length(output))
    front = F.split_part(body, second, F.lit(1))
    back = F.split_part(F.split_part(body, second, F.lit(2)), F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(body, F.lit(MIDDLE), F.lit(2))
    whole = F.when(form == "psm", F.concat(front, middle, back)).otherwise(F.concat(back, middle, front))
    return F.when(form == "plain", output).otherwise(whole)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed text and of the text restored from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l
    FROM documents
), drawn AS (
    SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS two,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM lines
), cut AS (
    SELECT doc_id, t, n,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(l[1:least(one, two)], '') AS p,
           array_to_string(l[least(one, two) + 1:greatest(one, two)], '') AS m,
           array_to_string(l[greatest(one, two) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""
