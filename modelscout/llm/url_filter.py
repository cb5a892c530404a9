"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

The filter of the listed canonical URLs is small and broadcast; a page that it turns away is surely not listed. The pages
it lets pass take an exact hash join with the list, which removes the false positives. Its size is bounded whatever the
list holds: a longer list makes it less selective, never wrong.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORDS = 8  # 64-bit words of a block; a key sets one bit in each of them
KEYS_PER_BLOCK = 32
MAX_BLOCKS = 1 << 16  # 4 MB of bits

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, leading ``www.``, query, fragment and closing slashes; NULL without ``://``."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path_of(url), r"/+$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together) whose host is the page's or a parent of it and whose
    path begins the page's path; NULLs where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def _bit(key: Column, word: Column | int) -> Column:
    """The bit of a key within a word: six bits of a hash for each of the eight words."""
    word = F.lit(word) if isinstance(word, int) else word
    shift = (word * 6).cast("int")
    at = F.call_function("shiftright", F.xxhash64(key, F.lit(2)), shift).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the non-empty blocks of the filter over the column ``url`` of ``listed``."""
    keys = listed.filter("url IS NOT NULL").select(_block(F.col("url"), blocks).alias("block"), "url")
    probes = keys.select("block", "url", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("word"))
    words = probes.groupBy("block", "word").agg(F.bit_or(_bit(F.col("url"), F.col("word"))).alias("mask"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"])
    return words.groupBy("block").agg(in_order.alias("bits"))


def url_verdicts(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    ``listed`` has a column ``url`` of canonical URLs (see :func:`canonical`); NULLs and repeats in it change nothing. A rule
    decides before the list does. A page without rule is blocked if its canonical URL is listed, else allowed. A NULL url,
    or one without ``://``, has an empty host and path, no rule, is never listed and so allowed. Repeated rows are judged
    each. An empty list or table is fine. Other columns are not read.
    """
    listed = listed.select("url").filter("url IS NOT NULL").distinct()
    blocks = max(1, min(max_blocks, math.ceil(listed.count() / KEYS_PER_BLOCK)))
    bloom = bloom_blocks(listed, blocks)

    url = F.col("url")
    host, path = host_of(url), path_of(url)
    own = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(url).alias("canonical"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "canonical")
    probed = ruled.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom), "block", "left")
    hit = F.lit(True)
    for word in range(WORDS):
        bit = _bit(F.col("canonical"), word)
        hit = hit & (F.col("bits")[word].bitwiseAND(bit) == bit)
    # a page that cannot be listed has no key and so meets nothing in the join
    keyed = probed.withColumn("key", F.when(F.coalesce(hit, F.lit(False)), F.col("canonical"))).drop("bits", "block", "canonical")
    listed_key = listed.select(F.col("url").alias("listed_url"))
    possible = keyed.filter("key IS NOT NULL").join(listed_key, F.col("key") == F.col("listed_url"), "left")
    other = keyed.filter("key IS NULL").withColumn("listed_url", F.lit(None).cast("string"))
    on_list = F.col("listed_url").isNotNull()
    judged = F.coalesce(F.col("ruled"), F.when(on_list, F.lit("block")).otherwise(F.lit("allow")))
    return possible.unionByName(other).select("page_id", "host", "path", "rule", judged.alias("verdict"), on_list.alias("listed"))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs that more than one page carries, as a list for :func:`url_verdicts`."""
    own = pages.select(canonical(F.col("url")).alias("url")).filter("url IS NOT NULL")
    return own.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the rules and against a list of URLs that the crawl brought more than once."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, repeated_urls(pages))


OP2_SQL = r"""
WITH own AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    contains(url, '://') AS whole
  FROM pages),
keyed AS (SELECT *, CASE WHEN whole THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM own),
ruled AS (
  SELECT *, count(*) OVER (PARTITION BY canonical) > 1 AND canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
