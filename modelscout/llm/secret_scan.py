"""Secret scans over a ledger of blobs: every version of a file is known by the digest of its content, only pairs of blob and
rule version that no earlier scan has seen are scanned, and the findings are joined back to all paths.

The ledger and the findings are Parquet tables. Findings are written before the ledger, so a scan that breaks off is done
again and nothing is missed; findings written twice are read once.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelscout.sources.scratch import scratch_path

FINDINGS = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"
LEDGER = "blob string, seen array<string>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


# Fixed values of the three kinds that every scan reports; the hexadecimal run is looked for at its least length, which
# finds the same spans as taking every run and dropping the short ones.
ASSIGN = Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24)
BASE = (ASSIGN, ACCESS, HEX)
# Kinds added to them.
PEM = Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
RULES = (*BASE, PEM)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """The sum of an array<bigint> up to each of its places.

    A fold copies its array with every step. So the array is cut into blocks of about the square root of its length: sums run
    within each block, then over the blocks, and n values cost n ** 1.5 short steps and not n ** 2.
    """
    none = F.array().cast("array<bigint>")

    def fold(xs: Column, first: Column) -> Column:
        """Sums up to each place, after ``first``."""
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), first.alias("sums"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["sums"], F.array(s["sum"] + x)).alias("sums"))
        return F.aggregate(xs, start, step, lambda s: s["sums"])

    def in_blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return _named(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(xs), w), lambda at: fold(F.slice(xs, at, w), none)))

    def moved(blocks: Column) -> Column:
        before = fold(F.transform(blocks, lambda b: F.element_at(b, -1)), F.array(F.lit(0).cast("bigint")))
        pairs = F.slice(F.arrays_zip(blocks.alias("block"), before.alias("before")), F.lit(1), F.size(blocks))
        return F.flatten(F.transform(pairs, lambda p: F.transform(p["block"], lambda x: x + p["before"])))

    return _named(values, lambda xs: F.when(F.size(xs) > 0, _named(in_blocks(xs), moved)).otherwise(none))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches in code points, end exclusive.

    The text between the matches and the matches themselves come from the same pattern, so their lengths add up to the
    places. The group is looked up in the matches, which are short. No pattern here matches the empty text.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pattern = F.lit(rule.pattern)

    def placed(between: Column, matches: Column) -> Column:
        whole = F.transform(matches, lambda x: F.length(x).cast("bigint"))
        steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, n: F.length(gap) + n)
        inner = whole if rule.group == 0 else F.transform(matches, lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group)).cast("bigint"))
        found = F.zip_with(running_sums(steps), F.arrays_zip(whole.alias("n"), inner.alias("inner")),
                           lambda end, x: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["inner"].alias("inner")))
        kept = F.filter(found, lambda x: x["inner"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    both = F.struct(F.split(text, rule.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"))
    found = _named(both, lambda p: placed(p["between"], p["matches"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty before the first write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_new_blobs(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, id: str = "doc_id", text: str = "text") -> int:
    """Scan the pairs of blob and rule version in ``versions`` that the ledger in ``folder`` has not seen; how many blobs.

    ``versions`` has one row per version of a path. NULL counts as the empty text. A blob is read once, at its smallest id.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), F.col(id).alias("id")).groupBy("blob").agg(F.min("id").alias("at"))
    seen = _stored(spark, f"{folder}/ledger", LEDGER).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = blobs.join(seen, "blob", "left").select("blob", "at", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = todo.filter(F.size("todo") > 0)
    todo_path = scratch_path(spark, "secret-todo")
    todo.write.parquet(todo_path)
    todo = spark.read.parquet(todo_path)
    n = todo.count()
    if not n:
        return 0
    # Ids may repeat: the digest decides again, and equal rows give the same findings, which are read once.
    read = versions.select(F.col(id).alias("id"), body.alias("body")).join(todo, F.col("id").eqNullSafe(F.col("at")))
    read = read.filter(F.sha2("body", 256) == F.col("blob"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", r.key), spans(F.col("body"), r)).otherwise(none).alias("spans"),
        )
        for r in rules
    ]
    per_rule = read.select("blob", F.explode(F.array(*found)).alias("x")).select("blob", "x.rule", "x.version", "x.spans")
    per_rule.filter(F.size("spans") > 0).write.mode("append").parquet(f"{folder}/findings")
    todo.select("blob", F.col("todo").alias("seen")).write.mode("append").parquet(f"{folder}/ledger")
    return n


def blob_spans(spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per blob with findings of the given rule versions: blob, found (array of start, order, kind, end)."""
    versions = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    table = _stored(spark, f"{folder}/findings", FINDINGS).filter(F.struct("rule", "version").isin(*versions))
    once = table.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("place"), F.col("rule").alias("kind"), s["end"].alias("end")))
    return once.select("blob", one.alias("found")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def scan_documents(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger in ``folder`` up to date and return, per row of ``versions``: doc_id, blob, found.

    ``found`` is an array of (start, place, kind, end) by start and then by the order of the rules; empty where nothing was
    found. A NULL or empty text is a blob like any other, without findings. Rows that repeat give their rows each. An empty
    table gives no rows. Other columns are not read.
    """
    spark = versions.sparkSession
    scan_new_blobs(versions, folder, rules, id, text)
    paths = versions.select(F.col(id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.join(blob_spans(spark, folder, rules), "blob", "left").withColumn("found", F.coalesce("found", none))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions, against a ledger that begins empty."""
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "secret-ledger"))
    base = F.filter("found", lambda x: x["kind"].isin(*[r.name for r in BASE]))
    kinds = F.transform("found", lambda x: x["kind"])
    number = [(F.size(kinds) - F.size(F.array_remove(kinds, r.name))).cast("bigint").alias(f"n_{r.name}") for r in BASE]
    return found.select("doc_id", *number, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
