"""Mixing sources to target weights by hierarchical budgets over the tree domain > language > source.

Capacities go up the tree, budgets come down: the budget of a node is dealt to its children by weight, and what a child
cannot take goes to its siblings. A node never gets more than its descendants can take, so a shortage is made good by the
nearest relatives, and reaches the children of an ancestor only when no sibling has anything left.

A leaf gives whole epochs of its documents and then the beginning of one more, in an order drawn from the seed and the
number of the epoch. How far that beginning goes is one key per leaf, so choosing the documents needs no shuffle of texts.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from modelscout.llm.names import free_names
from modelscout.sources.scratch import materialize

LEAF = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # of the hexadecimal key; the documents of a leaf meet in 4,096 parts
WORD = r"[^\x20\x09-\x0D]+"

#: Default tree: sources by domain, and whole-number weights; a name that is not listed has weight 1.
DOMAINS = {"books": tuple(f"src{i}" for i in range(10, 15)), "code": tuple(f"src{i}" for i in range(15, 20))}
OTHER_DOMAIN = "web"
WEIGHTS = {"domain": {"web": 50, "books": 30, "code": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}


def domain_of(source: Column, domains: Mapping[str, tuple[str, ...]] = DOMAINS, other: str = OTHER_DOMAIN) -> Column:
    out = F.lit(other)
    for name, sources in domains.items():
        out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
    return out


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        if w <= 0:
            raise ValueError(f"weight of {level} {name} is not positive")
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def water_fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``share``: the ``budget`` of each parent dealt to its children by ``weight``, none above its ``capacity``.

    In the order of capacity by weight, every child that can be filled is; the others divide the rest by weight. Shares are
    whole numbers, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - before).cast("double") / later
    steps = children.withColumn("level", level).withColumn("place", F.row_number().over(order))
    open_ = F.when(F.col("level") < F.col("capacity") / F.col("weight"), F.struct("place", "level"))
    first = F.min(open_).over(Window.partitionBy(*parent))
    part = F.floor(first["level"] * F.col("weight")).cast("bigint")
    return steps.withColumn("share", F.coalesce(F.greatest(F.least("capacity", part), F.lit(0)), F.col("capacity"))).drop("level", "place")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, share) from (domain, lang, source, tokens): what each leaf is to give."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    # the total is one number per leaf added up; the budget is a share of it
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("bigint").alias("budget"))
    budget = total.first()["budget"]
    above: DataFrame | None = None
    for depth in range(1, len(LEAF) + 1):
        keys = list(LEAF[:depth])
        if depth < len(LEAF):
            level = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        else:
            level = leaves
        level = level.withColumn("weight", _weight(keys[-1], weights))
        if above is None:
            level = level.withColumn("budget", F.lit(budget)).withColumn("root", F.lit(0))
            above = water_fill(level, ["root"], keys[-1]).drop("root")
        else:
            level = level.join(above.select(*keys[:-1], F.col("share").alias("budget")), keys[:-1])
            above = water_fill(level, keys[:-1], keys[-1])
    return above.select(*LEAF, "tokens", "share")


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens); tokens are words, NULLs count as ''."""
    place = F.coalesce(F.col(source), F.lit(""))
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select(
        F.col(id).alias("doc_id"), domain_of(place).alias("domain"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), place.alias("source"), count.alias("n_tokens")
    )


def mixing_plan(sizes: DataFrame, share: float, epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """(domain, lang, source, share, full, upto): whole epochs of each leaf, and the last key of the epoch that is begun
    ('' if none of it is taken). One row per leaf, written once."""
    leaves = sizes.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, share, epochs, weights)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(F.lit(epochs)).cast("bigint")
    budgets = budgets.withColumn("full", full).withColumn("rest", F.col("share") - F.col("full") * F.col("tokens"))
    budgets = materialize(budgets.drop("tokens"), "mixing-budgets")

    begun = sizes.join(budgets.filter("rest > 0"), list(LEAF)).withColumn("key", _key(seed, F.col("full")))
    begun = begun.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    per_bucket = begun.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    by_bucket = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    # the bucket in which the budget ends; before it everything is taken
    ends = per_bucket.withColumn("after", F.sum("n").over(by_bucket)).filter("after >= rest")
    ends = ends.groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("after") - F.col("n")).alias("before"))).alias("end"))
    ends = materialize(ends.select(*LEAF, "end.bucket", "end.before"), "mixing-ends")
    last = begun.join(ends, [*LEAF, "bucket"]).groupBy(*LEAF, "rest", "before", "key").agg(F.sum("n_tokens").alias("n"))
    by_key = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(by_key), F.lit(0))
    upto = last.withColumn("start", start).filter("start < rest").groupBy(*LEAF).agg(F.max("key").alias("upto"))
    plan = budgets.join(upto, list(LEAF), "left").select(*LEAF, "share", "full", F.coalesce("upto", F.lit("")).alias("upto"))
    return materialize(plan, "mixing-plan")


def mix(
    docs: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 17, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, copies (0: not chosen).

    The budget is ``share`` of all tokens, rounded down; no document is taken more than ``epochs`` times. The document in
    which a leaf's budget ends is taken whole. NULL texts have no tokens; NULL languages and sources are ''. A leaf without
    tokens gives its documents ``epochs`` times. Rows that repeat an id count each and stand or fall together. An empty
    table gives no rows. Other columns are not read.
    """
    sizes = materialize(sized(docs, id, text, lang, source), "mixing-sizes")
    plan = mixing_plan(sizes, share, epochs, seed, weights)
    copies = F.col("full") + (_key(seed, F.col("full")) <= F.col("upto")).cast("bigint")
    return sizes.join(plan, list(LEAF)).select("doc_id", *LEAF, "n_tokens", copies.alias("copies"))


def mixed_documents(
    docs: DataFrame, share: float = 0.9, epochs: int = 1, seed: int = 17, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` chooses, with all their columns, each as often as chosen.

    The plan has one row per leaf; Spark broadcasts it if its file is small, else it joins by leaf.
    """
    own_lang, own_source, copy, *names = free_names(docs.columns, "own_lang", "own_source", "copy", *[f"plan_{c}" for c in (*LEAF, "full", "upto")])
    _, its_lang, its_source, full, upto = names
    sizes = materialize(sized(docs, id, text, lang, source), "mixing-sizes")
    plan = mixing_plan(sizes, share, epochs, seed, weights).select(*[F.col(c).alias(n) for c, n in zip((*LEAF, "full", "upto"), names)])
    place = F.coalesce(F.col(source), F.lit(""))
    marked = docs.withColumns({own_lang: F.coalesce(F.col(lang), F.lit("")), own_source: place})
    joined = marked.join(plan, (F.col(own_lang) == F.col(its_lang)) & (F.col(own_source) == F.col(its_source)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(full).cast("string"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    copies = (F.col(full) + (key <= F.col(upto)).cast("bigint")).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level_sql(name: str, source: str, parent: str, child: str) -> str:
    by = f"PARTITION BY {parent}"
    order = f"{by} ORDER BY capacity / weight, {child}"
    return f"""
{name}_a AS (
  SELECT *, row_number() OVER (w) AS place,
    (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {source} WINDOW w AS ({order})),
{name}_b AS (SELECT *, CASE WHEN level < capacity / weight THEN place END AS open FROM {name}_a),
{name}_c AS (SELECT *, arg_min(level, open) OVER ({by}) AS fill FROM {name}_b),
{name} AS (SELECT *, coalesce(greatest(least(capacity, floor(fill * weight)::BIGINT), 0), capacity) AS share FROM {name}_c)"""


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'books'
                      WHEN source IN ('src15', 'src16', 'src17', 'src18', 'src19') THEN 'code' ELSE 'web' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS capacity FROM d GROUP BY ALL),
top AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'web' THEN 50.0::DOUBLE WHEN 'books' THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END AS weight,
    (SELECT floor(sum(tokens)::DOUBLE * 0.5::DOUBLE)::BIGINT FROM leaves) AS budget, 0 AS root
  FROM leaves GROUP BY domain),
{_level_sql("top_dealt", "top", "root", "domain").strip()},
middle AS (
  SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, any_value(t.share) AS budget,
    CASE l.lang WHEN 'en' THEN 50.0::DOUBLE WHEN 'de' THEN 20.0::DOUBLE WHEN 'fr' THEN 20.0::DOUBLE WHEN 'es' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM leaves l JOIN top_dealt t USING (domain) GROUP BY l.domain, l.lang),
{_level_sql("middle_dealt", "middle", "domain", "lang").strip()},
low AS (SELECT l.*, m.share AS budget, 1.0::DOUBLE AS weight FROM leaves l JOIN middle_dealt m USING (domain, lang)),
{_level_sql("low_dealt", "low", "domain, lang", "source").strip()},
goals AS (SELECT domain, lang, source, tokens, share, CASE WHEN tokens > 0 THEN share // tokens ELSE 2 END AS whole FROM low_dealt),
keyed AS (
  SELECT d.*, whole, share - whole * tokens AS rest, md5(concat('17|', whole, '|', coalesce(doc_id::VARCHAR, ''))) AS key
  FROM d JOIN goals USING (domain, lang, source)),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start
  FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS copies FROM placed
"""
