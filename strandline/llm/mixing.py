"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are aggregated per source; targets are shares of the total by
weight, each at most ``limit`` times its source's size, the excess going to the
others by weight (a water level found in closed form over sources ordered by
size/weight). A document is then taken floor(rate) times, plus one copy by a
Bernoulli draw from a seeded hash of its id with the rate's fraction as
probability. Among ``SEEDS`` hash seeds the one whose draw comes nearest to the
source's target is used, which one aggregation decides.

Sources are ranked and summed in sorted ranges with an offset for each range, so no
task sees all of them, however many there are.

Defined cases: null text has size 0; null source is a source of its own and comes
last; repeated rows are separate documents that draw alike; a source whose
documents are all empty has target 0 and takes nothing; an empty table gives an
empty result; documents without doc_id draw by their text; extra columns, also of
clashing names, are ignored by ``mix`` and kept by ``resample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.words import n_words
from strandline.runtime import durable, join_small, table

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEEDS = 64
GRAIN = 1 << 32


def with_draw(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, ``more`` and two numbers below GRAIN from the md5 of the id, or of the text where that is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("text")), F.lit(""))
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(name.cast("binary")).alias("m"), *more)
    part = lambda k: F.conv(F.substring("m", k, 8), 16, 10).cast("bigint")
    return d.select("doc_id", "source", "size", part(1).alias("a"), part(9).alias("b"), *more)


def draw(seed: Column) -> Column:
    """A whole number in [0, GRAIN): (a + seed * b) mod GRAIN."""
    return F.pmod(F.col("a") + seed * F.col("b"), F.lit(GRAIN))


def _ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted, durable, with _range and _at (place there): each range is a partition."""
    return durable(df.orderBy(*order)).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})


def _before(ranged: DataFrame, name: str, amount: Column) -> DataFrame:
    """``ranged`` with the sum of ``amount`` over all rows before each."""
    w = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    whole = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum(amount).alias("_s"))  # a row for each partition
    base = whole.select("_r", F.coalesce(F.sum("_s").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    d = ranged.join(F.broadcast(base), F.col("_range") == F.col("_r"))
    return d.withColumn(name, F.col("_base") + F.coalesce(F.sum(amount).over(w), F.lit(0))).drop("_r", "_base")


def source_targets(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, source_size, weight, target. ``sized`` has source and size."""
    last = F.col("source").asc_nulls_last()
    by = _before(_ranges(sized.groupBy("source").agg(F.sum("size").alias("source_size")), last), "_rank", F.lit(1))
    turn = (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int")
    by = by.select("source", "source_size", F.element_at(F.array(*[F.lit(x) for x in weights]), turn).alias("weight"))
    by = _ranges(by, F.col("source_size") / F.col("weight"), last)
    all_ = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by = _before(_before(by, "_full", F.lit(limit) * F.col("source_size")), "_light", F.col("weight"))
    # if all sources before this one stop at their limit, this is the level of the rest
    level = (F.lit(all_["size"]) - F.col("_full")) / (F.lit(all_["weight"]) - F.col("_light"))
    best = by.select(F.max(F.when(level * F.col("weight") <= limit * F.col("source_size"), level))).first()[0]  # the first that fits; later ones are lower
    return by.select("source", "source_size", "weight", F.least(F.lit(best).cast("double") * F.col("weight"), (limit * F.col("source_size")).cast("double")).alias("target"))


def source_plan(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One durable row per source: source_size, target, whole copies, the draw's bound and its seed."""
    targets = durable(source_targets(sized, weights, limit))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("cut", F.floor((rate - F.floor(rate)) * GRAIN))
    parts = join_small(sized, targets, ["source"], "left")
    hit = lambda k: F.when(draw(F.lit(k)) < F.col("cut"), F.col("size")).otherwise(0)
    tried = parts.groupBy("source", "source_size", "target", "whole", "cut").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), *[F.sum(hit(k)).alias(f"s{k}") for k in range(SEEDS)])
    miss = lambda k: F.struct(F.abs(F.col("sure") + F.col(f"s{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k"))
    seed = F.array_min(F.array(*[miss(k) for k in range(SEEDS)]))["k"]
    return durable(tried.select("source", "source_size", "target", "whole", "cut", seed.alias("seed")))


def _copies() -> Column:
    return (F.col("whole") + F.when(draw(F.col("seed")) < F.col("cut"), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs``."""
    sized = durable(with_draw(docs))
    out = join_small(sized, source_plan(sized, weights, limit), ["source"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def resample(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, same columns.

    Whole rows meet only the small table of sources, so texts are not shuffled."""
    plan = source_plan(durable(with_draw(docs)), weights, limit).select("source", "whole", "cut", "seed")
    rows = with_draw(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "row")
    taken = join_small(rows, plan, ["source"], "left")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same arithmetic in DuckDB.
OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, size, CAST('0x' || substr(m, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(m, 9, 8) AS BIGINT) AS b FROM (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '#' || text, '')) AS m,
           CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
level AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
     - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
     / CAST(sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lev
  FROM per),
targets AS (
  SELECT source, source_size,
         least(max(CASE WHEN lev * weight <= 3 * source_size THEN lev END) OVER () * weight, CAST(3 * source_size AS DOUBLE)) AS target
  FROM level),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
plan AS (
  SELECT source, source_size, target, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * 4294967296) AS BIGINT) AS cut FROM rates),
draws AS (
  SELECT d.source, d.doc_id, d.size, k.k, (d.a + k.k * d.b) % 4294967296 AS u
  FROM sized d, range(64) k(k)),
tried AS (
  SELECT p.source, d.k, abs(CAST(sum(p.whole * d.size + CASE WHEN d.u < p.cut THEN d.size ELSE 0 END) AS BIGINT) - any_value(p.target)) AS miss
  FROM draws d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source GROUP BY p.source, d.k),
seeds AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.whole + CASE WHEN d.u < p.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM draws d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.k = s.k
"""
