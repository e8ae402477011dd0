"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule is ``host/path``, given as such or as a URL, which is made canonical first
(scheme, query and fragment go, the host is lower-cased). It fits its host and all
subdomains of it, if the URL's path starts with the rule's. Of the rules that fit, the
longest decides. Hosts come first: every dot-bounded suffix of a URL's host is looked
up among the listed hosts; then, with only those path lengths that rules of that host
have, host and path prefix are looked up among the rules. Each look-up tests distinct
texts by the Bloom filter; the few that pass meet the list in an exact equi-join, which
removes false positives.

The filter has 512-bit blocks: one hash picks the block, others the bits, so a look-up
touches one block. It is a table with a row for each block, built by OR-ing bits with
map-side combine, and candidates meet it by block: the blocks are broadcast while they
are ``BROADCAST_ROWS`` at most, beyond that both sides are dealt by block. Only the join
strategy differs; there is no list too long for the filter. All of it is JVM functions.

Defined cases: null URLs and those without ``://`` have an empty host and path,
fit no rule and are allowed; repeated rows are judged alike; of rules with equal
text, block wins; an empty table gives an empty result, an empty list allows all;
extra columns are ignored; rows are told apart without their ids, which may be
null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import BROADCAST_ROWS, durable, join_small, table

#: The contract's rules (fixed values): verdict, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BLOCK_BITS, HASHES, BITS_PER_KEY = 512, 7, 16
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), A_TO_Z, a_to_z)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def canonical(url: Column) -> Column:
    """A listed URL as a rule's text: scheme, query and fragment go, the host is lower-cased."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), A_TO_Z, a_to_z)
    return F.concat(host, F.regexp_extract(rest, r"^[^/]*(.*)$", 1))


def _place(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block of a text and its HASHES bits inside the block: nine bits each of a second hash."""
    h = F.xxhash64(key)
    bits = F.xxhash64(h)
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)), [F.shiftrightunsigned(bits, 9 * k).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("bigint")) for k in range(HASHES)]


def build_filter(keys: DataFrame, name: str, n_keys: int) -> tuple[DataFrame, int]:
    """The blocked filter over the texts of a column: rows (block, w0 to w7), durable, and the number of blocks."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    block, bits = _place(F.col(name), n_blocks)
    at = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("at"))
    word = lambda k: F.bit_or(F.when(F.shiftright("at", 6) == k, F.expr("shiftleft(1L, cast(at & 63 as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}")
    return durable(at.groupBy("block").agg(*[word(k) for k in range(8)])), n_blocks


def maybe_in(texts: DataFrame, name: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Rows of ``texts`` (one column) that the filter does not rule out."""
    rows, n_blocks = filter_
    block, bits = _place(F.col(name), n_blocks)
    met = texts.withColumn("block", block).join(F.broadcast(rows) if n_blocks <= BROADCAST_ROWS else rows, "block")
    words = F.array(*[F.col(f"w{k}") for k in range(8)])
    ok = F.lit(True)
    for at in bits:
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        ok = ok & (F.call_function("shiftright", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return met.where(ok).select(name)


def look_up(candidates: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """``candidates`` joined with ``listed`` (durable) on the text ``name``: distinct texts pass the filter, then an exact join."""
    some = maybe_in(candidates.select(name).distinct(), name, build_filter(listed, name, listed.count()))
    found = durable(some.join(listed, name))
    return join_small(candidates, found, [name])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. ``rules`` has key (``host/path`` or a URL) and verdict."""
    named = rules.where("key is not null").select(canonical(F.col("key")).alias("key"), "verdict").where("key != ''")
    rules = durable(named.groupBy("key").agg(F.max("verdict").alias("verdict")))  # block > allow
    host = F.regexp_extract("key", r"^([^/]*)", 1)
    hosts = durable(rules.select(host.alias("suffix"), (F.length("key") - F.length(host)).alias("n")).groupBy("suffix").agg(F.array_sort(F.collect_set("n")).alias("lengths")))
    urls = durable(with_host_path(pages.select("page_id", "url")).select("page_id", "host", "path"))
    labels_ = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels_)), lambda i: F.array_join(F.slice(labels_, i, F.size(labels_)), "."))
    places = urls.where("host != ''").select("host", "path").distinct().withColumn("suffix", F.explode(F.array_distinct(suffixes)))
    met = look_up(durable(places), "suffix", hosts)
    prefixes = F.transform(F.filter("lengths", lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = durable(met.withColumn("prefix", F.explode(prefixes)).select("host", "path", F.concat("suffix", "prefix").alias("key")))
    hits = look_up(keys, "key", rules)
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("_best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_q"), "_best")
    out = urls.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_q")), "left")
    return out.select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(k, v) for v, k in rules], "key string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT hp.*, rules.verdict, h || p AS rule FROM hp LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
