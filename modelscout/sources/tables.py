"""Table readers and writers: CSV, TSV and Parquet."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from modelscout.sources.records import find_ranges, read_records

# Options under which Spark tells records and columns apart in other ways.
RECORD_OPTIONS = {"header", "quote", "escape", "lineSep", "comment", "encoding", "charset", "multiLine", "mode", "charToEscapeQuoteEscaping",
                  "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "unescapedQuoteHandling", "columnNameOfCorruptRecord"}
SEPARATORS = {"csv": ",", "tsv": "\t"}
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def normalize_path(path: str) -> str:
    """``s3://`` locations are served by the ``s3a`` file system of Hadoop."""
    return "s3a:" + path[len("s3:"):] if path.startswith("s3:") else path


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = (),
    multi_line: bool = True,
    types: bool = True,
    **options: str,
) -> DataFrame:
    """Read a table with a header row (CSV, TSV, gzip by extension) or Parquet.

    In the text formats an empty field is a missing value, quoted or not, and so is each of ``null_values``. Fields may hold
    line breaks; a scan tells where records begin, so that many tasks read a large file all the same. ``multi_line=False`` saves
    that scan for files known to have none. Options that say how records are told apart leave a file to one task. Without
    a ``schema`` the text formats cost one more scan that finds the types, by one rule for all options; without ``types`` their
    columns stay text.
    """
    path = normalize_path(path)
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.options(**options).parquet(path)
    if fmt not in SEPARATORS:
        raise ValueError(f"unknown table format {fmt!r}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    given = {
        "header": True, "sep": SEPARATORS[fmt], "quote": '"', "escape": '"', "multiLine": multi_line,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **options,
    }
    ranges = None
    if multi_line and not set(options) & RECORD_OPTIONS:
        ranges = find_ranges(spark, path, given["sep"])
        given["multiLine"] = not ranges.plain
    reader = spark.read.options(**given)

    def read(kinds: T.StructType | None) -> DataFrame:
        if ranges is not None and not ranges.plain and ranges.split:
            names = kinds.names if kinds else reader.csv(path).columns
            return read_records(spark, path, names, kinds, given, ranges)
        return (reader.schema(kinds) if kinds else reader).csv(path)

    if schema is not None and not null_values:
        return read(schema)

    # Spark takes one marker only, and would judge types before markers are gone: read text, blank the markers, then cast
    text = read(None)
    if null_values:
        text = text.select([F.when(~F.col(c).isin(*null_values), F.col(c)).alias(n) for c, n in zip(_quoted(text), text.columns)])
    if schema is None:
        return _tighten(text) if types else text
    return text.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> str:
    """Write ``df`` with one file per task; text formats get a header in every file.

    Text keeps its blanks and line breaks. The text formats cannot tell an empty text from a missing one.
    """
    path = normalize_path(path)
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.options(**options).parquet(path)
    elif fmt in SEPARATORS:
        # the default formats would cut timestamps to milliseconds
        full = {"timestampNTZFormat": TIME, "timestampFormat": TIME + "XXX"}
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer = writer.options(header=True, sep=SEPARATORS[fmt], quote='"', escape='"', **full, **blanks)
        writer.options(**options).csv(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}")
    return path


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


# Types in the order in which they are tried, each with the texts that are taken for it.
KINDS = (
    ("int", r"[+-]?\d+"),
    ("bigint", r"[+-]?\d+"),
    ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity"),
    ("date", r"\d{4}-\d{2}-\d{2}"),
    ("timestamp_ntz", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})"),
    ("boolean", r"(?i)true|false"),
)


# Number types whose values another type holds as they are.
WIDER = {"tinyint": "smallint int bigint float double", "smallint": "int bigint float double", "int": "bigint double", "float": "double"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``; ``ValueError`` if names differ or a value would change.

    Text becomes a type if it is what :func:`read_table` takes for that type, other columns if the type is the same or wider. A
    column without values fits any type. Text costs one scan, which looks at all values first.
    """
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"columns {sorted(set(df.columns) ^ set(schema.names))} are not in both tables")
    patterns = dict(KINDS)
    kinds, out, odd = dict(df.dtypes), [], {}
    for f in schema.fields:
        c, have, want = F.col(f"`{f.name}`"), kinds[f.name], f.dataType.simpleString()
        if have == want or want in WIDER.get(have, "").split():
            out.append(c.cast(f.dataType).alias(f.name))
            continue
        out.append(c.try_cast(f.dataType).alias(f.name))
        fits = F.lit(False)
        if have == "string" and want in patterns:
            fits = c.rlike(f"^(?:{patterns[want]})$") & c.try_cast(f.dataType).isNotNull()
        odd[f.name] = F.count_if(c.isNotNull() & ~fits)
    if odd:
        counts = df.agg(*odd.values()).first()
        bad = {f"{n} ({kinds[n]} for {schema[n].dataType.simpleString()})": k for n, k in zip(odd, counts) if k}
        if bad:
            raise ValueError(f"values that do not fit: {bad}")
    return df.select(out)


# Kinds whose texts are also taken for kinds that come later; those of all others are taken for one kind only.
ALSO = {"int": ("bigint", "double"), "bigint": ("double",)}


def _tighten(text: DataFrame) -> DataFrame:
    """Give every all-text column the first of KINDS that holds all its values; a column without values stays text.

    A value is tried until its first kind is found, which tells all the kinds it is taken for.
    """
    columns = _quoted(text)

    def first_kind(c: str) -> Column:
        found = F.when(F.col(c).isNull(), -2)
        for k, (kind, pattern) in enumerate(KINDS):
            found = found.when(F.col(c).rlike(f"^(?:{pattern})$") & F.col(c).try_cast(kind).isNotNull(), k)
        return found.otherwise(-1)

    kinds = text.select([first_kind(c).alias(f"{i}") for i, c in enumerate(columns)])
    counts = [F.count_if(F.col(f"{i}") == k).alias(f"{i}_{kind}") for i in range(len(columns)) for k, (kind, _) in enumerate(KINDS)]
    held = [F.count_if(F.col(f"{i}") > -2).alias(f"{i}") for i in range(len(columns))]
    seen = kinds.agg(*held, *counts).first()
    out = []
    for i, (c, name) in enumerate(zip(columns, text.columns)):
        fits = {kind: seen[f"{i}_{kind}"] + sum(seen[f"{i}_{k}"] for k, more in ALSO.items() if kind in more) for kind, _ in KINDS}
        kind = next((k for k, _ in KINDS if seen[f"{i}"] and fits[k] == seen[f"{i}"]), "string")
        out.append(F.col(c).try_cast(kind).alias(name))
    return text.select(out)
