"""URL verdicts: rules by host suffix and path prefix, then a blocked Bloom filter and an exact hash join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Canonical URLs of listed sites and pages; a listed site stands as host and "/".
LISTED = ("spam-farm.example.org/", "cheap-pills.example.com/", "casino-win.example.org/", "free-bets.example.com/", "ads-track.example.org/", "thther.example.org/en/685", "thther.example.org/en/25", "tionsh.example.net/listed/page")
#: Listed keys for each 64-bit block of the filter. Up to so many blocks are broadcast (two longs each, so 16 MB at
#: most); beyond, the filter is joined.
KEYS_A_BLOCK, BROADCAST_BLOCKS = 4, 1 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.substring_index(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(F.substring(bare, F.length(host) + 1, F.length(bare)), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without leading www. or m. (unless but one label would be left), path without index page and closing
    slashes; "/" between them."""
    site = F.regexp_replace(host, "^(www|m)\\.(?=[^.]+\\.)", "")
    return F.concat(site, F.lit("/"), F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/index\\.html?$", "/"), "/+$", ""), "^/+", ""))


#: Four bits of a key in its 64-bit block.
_WORD = " | ".join(f"shiftleft(1L, cast(shiftright(xxhash64(key, 'bits'), {6 * k}) & 63 as int))" for k in range(4))


def listed_hits(keys: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """Distinct keys (column key) that are listed: Bloom filter blocks first, then the exact join."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    listed = listed.where("key is not null").distinct()
    bloom = listed.groupBy(block(F.col("key")).alias("block")).agg(F.bit_or(F.expr(_WORD)).alias("word"))
    possible = keys.withColumn("block", block(F.col("key"))).withColumn("mask", F.expr(_WORD)).join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "word", "mask")
    return possible.join(listed, "key", "left_semi")


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    A rule's verdict wins (longest host and path pattern; rules are a fixed parameter list). Else a page whose
    canonical URL or site is listed is blocked, any other allowed. Null URLs and URLs without :// have empty host
    and path and are allowed. listed: a table with a column key of canonical URLs; the filter is sized by their
    number unless `blocks` says otherwise. Rules that tie in length can't fit the same URL unless they are equal.
    Repeated rows stay; other columns are ignored."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for pattern, v in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        h, _, rest = pattern.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, v).otherwise(verdict)
    p = p.withColumn("rule", rule).withColumn("by_rule", verdict)
    listed = listed if listed is not None else spark.createDataFrame([(x,) for x in LISTED], "key string")
    blocks = blocks or max(64, -(-listed.count() // KEYS_A_BLOCK))
    url = canonical(F.col("host"), F.col("path"))
    free = p.where("rule is null and host != ''").select("host", "path").distinct()
    keys = free.select("host", "path", F.explode(F.array_distinct(F.array(url, F.concat(F.substring_index(url, "/", 1), F.lit("/"))))).alias("key"))
    hits = listed_hits(keys, listed, blocks).select(F.col("host").alias("h"), F.col("path").alias("q")).distinct().withColumn("hit", F.lit(True))
    # rows that no key can hit are dealt by their id, so that a rule's or an empty host's rows don't meet in one task
    asks = F.col("rule").isNull() & (F.col("host") != "")
    p = p.withColumn("deal", F.when(asks, F.xxhash64("host", "path")).otherwise(F.xxhash64("page_id", F.lit(5))))
    hits = hits.withColumn("dealt", F.xxhash64("h", "q"))
    p = p.join(hits, (F.col("deal") == F.col("dealt")) & (p.host == F.col("h")) & (p.path == F.col("q")) & p.rule.isNull(), "left")
    return p.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(split_part(split_part(split_part(rest, '#', 1), '?', 1), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, split_part(split_part(rest, '#', 1), '?', 1) AS bare FROM u),
p AS (SELECT page_id, host, substr(bare, length(host) + 1) AS path FROM h),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN site || '/' IN (LISTED) OR site || '/' || regexp_replace(regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', ''), '^/+', '') IN (LISTED) THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE WHEN regexp_matches(host, '^(www|m)\\.[^.]+\\.') THEN regexp_replace(host, '^(www|m)\\.', '') ELSE host END AS site FROM r)
""".replace("LISTED", ", ".join(f"'{x}'" for x in LISTED))
