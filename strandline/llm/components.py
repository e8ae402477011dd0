"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Every step is a minimum per node with map-side combine and a join back, so a hub
with many neighbours is never gathered in one task. Steps are checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import durable


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node it reaches) for every node that has an edge to another."""
    e = durable(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    was = _state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(low.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(hang.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
