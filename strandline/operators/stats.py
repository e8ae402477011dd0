"""Robust aggregates, majority groups, priors and boundary metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def motif_priors(pairs: DataFrame, keys: list[str], step: int = 120, least: int = 6) -> DataFrame:
    """``pairs`` (raw_dur, raw_gap, lyric) with the prior of its motif: rows of equal rounded duration, gap and tie.

    The motif table has one row for each combination, so the join back is on a small side; rare motifs get count 1, strength 0."""
    half = lambda c: F.rint(F.col(c) / F.lit(float(step))).cast("bigint")
    d = pairs.withColumns({"k_dur": F.greatest(F.lit(1), half("raw_dur")).cast("bigint"), "k_gap": half("raw_gap"), "k_tie": F.col("lyric") == "-"})
    motif = ["k_dur", "k_gap", "k_tie"]
    by = d.groupBy(*keys, *motif).agg(F.count("*").alias("n"), F.median("raw_dur").alias("med_dur"), F.median("raw_gap").alias("med_gap")).where(F.col("n") >= least)
    by = by.withColumn("strength", F.least(F.lit(0.65), 0.18 + 0.12 * (F.col("n") - least)))
    return d.join(by, [*keys, *motif], "left").withColumns({"n": F.coalesce("n", F.lit(1)), "strength": F.coalesce("strength", F.lit(0.0))})


def phase_center(pairs: DataFrame, keys: list[str], step: int = 120) -> DataFrame:
    """Median shift to the nearest grid line of each group, the mean absolute deviation around it and the strength of the two."""
    shift = F.col("raw_start") - F.rint(F.col("raw_start") / F.lit(float(step))).cast("bigint") * step
    d = pairs.select(*keys, shift.alias("shift"), F.pmod(F.col("raw_start"), F.lit(step)).alias("phase"))
    m = d.groupBy(*keys).agg(F.median("shift").alias("center"), F.median("phase").alias("phase_med"), F.count("*").alias("n"))
    out = d.join(m, keys).groupBy(*keys, "center", "phase_med", "n").agg(F.avg(F.abs(F.col("shift") - F.col("center"))).alias("spread"))
    return out.withColumn("strength", F.greatest(F.lit(0.0), 1 - F.least(F.col("spread") / (0.4 * step), F.lit(1.0))))


def robust_mean(rows: DataFrame, keys: list[str], value: str, limit: float = 1.5) -> DataFrame:
    """Median, median absolute deviation, and the mean of values whose modified z is within ``limit`` (the median if there is no spread or none is)."""
    m = rows.groupBy(*keys).agg(F.median(value).alias("med"))
    d = rows.join(m, keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = d.groupBy(*keys).agg(F.median("_dev").alias("mad"))
    near = F.when((F.col("mad") > 0) & (F.col("_dev") / (1.4826 * F.col("mad")) <= limit), F.col(value))
    return d.join(mad, keys).groupBy(*keys, "med", "mad").agg(F.coalesce(F.avg(near), F.first("med")).alias("robust"), F.count(near).alias("kept"))


def majority(rows: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """The most frequent value of ``item`` (an array) in each group: by count, then length, then first seen."""
    g = rows.groupBy(*keys, item).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.size(item).desc(), "first_seen"))
    return g.withColumn("_r", best).where("_r = 1").drop("_r")


def consolidate(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Boundaries of several passes (keys, pass, ph_idx, start, end) as one: robust means, start not before the previous end, end after start."""
    s = robust_mean(bounds, [*keys, "ph_idx"], "start").select(*keys, "ph_idx", F.col("robust").alias("s"))
    e = robust_mean(bounds, [*keys, "ph_idx"], "end").select(*keys, "ph_idx", F.col("robust").alias("e"))
    rows = s.join(e, [*keys, "ph_idx"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ph_idx", "s", "e"))).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(x["s"], F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], x["s"]))
        return F.concat(acc, F.array(F.struct(x["ph_idx"].alias("ph_idx"), start.alias("start"), F.greatest(x["e"], start + 1e-4).alias("end"))))

    return rows.select(*keys, F.inline(F.aggregate("r", F.array().cast("array<struct<ph_idx:bigint,start:double,end:double>>"), step)))


def best_parameters(durations: DataFrame, mins: list[float], maxs: list[float]) -> DataFrame:
    """The pair of bounds with the lowest score over a grid: short 1.5, long 1, and half the distance from the expected number; the first on a tie."""
    spark = durations.sparkSession
    grid = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in mins for b in maxs)], "ordinal int, lo double, hi double")
    d = durations.join(F.broadcast(grid))  # as many copies as the grid has cells
    by = d.groupBy("ordinal", "lo", "hi").agg(F.sum(F.when(F.col("dur") < F.col("lo"), 1).otherwise(0)).alias("short"), F.sum(F.when(F.col("dur") > F.col("hi"), 1).otherwise(0)).alias("long"), F.count("*").alias("n"), F.sum("dur").alias("total"))
    score = F.col("short") * 1.5 + F.col("long") + 0.5 * F.abs(F.col("n") - F.col("total") / ((F.col("lo") + F.col("hi")) / 2))
    return by.withColumn("score", score).agg(F.min_by(F.struct("lo", "hi", "score"), F.struct("score", "ordinal")).alias("b")).select("b.*")


def chunk_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min_dur"), F.max(value).alias("max_dur"), F.avg(value).alias("avg_dur"))


def total_confidence(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.exp(F.avg(F.log(F.col(value) + 1e-6)) / 3).alias("confidence"))


def iou_by_mark(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of equal marks over the rest of both (keys, start, end, mark), to six places; 0 without overlap."""
    from strandline.operators.intervals import overlap_join

    both = overlap_join(a, b.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "mark"), [*keys, "mark"], 4.0)
    inter = both.groupBy("mark").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("inter"))
    total = a.select("mark", "start", "end").unionByName(b.select("mark", "start", "end")).groupBy("mark").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    inter_ = F.coalesce(F.col("inter"), F.lit(0.0))
    return total.join(inter, "mark", "left").select("mark", F.coalesce(F.round(inter_ / F.nullif(F.col("total") - inter_, F.lit(0.0)), 6), F.lit(0.0)).alias("iou"))


def boundary_distance(pred: DataFrame, target: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Sum of distances of paired boundaries (keys, place, t), and that over the target's span."""
    d = pred.select(*keys, place, F.col("t").alias("p")).join(target.select(*keys, place, F.col("t").alias("q")), [*keys, place])
    span = F.max("q") - F.min("q")
    return d.groupBy(*keys).agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("distance"), span.alias("span")).withColumn("ratio", F.col("distance") / F.nullif(F.col("span"), F.lit(0.0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, counted as often as the rarer side has them."""
    times = lambda x, t: F.size(F.filter(x, lambda v: v == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(times(a, t), times(b, t)))


def difference_count(a: Column, b: Column) -> Column:
    """Places at which two arrays differ, and the difference of their lengths."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v) + F.abs(F.size(a) - F.size(b))
