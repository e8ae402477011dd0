"""Ordered series: fills, smoothing, runs, collapse and framewise scores, by window and array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_linear(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Nulls between known values are interpolated by place, the head takes the first and the tail the last known value."""
    w = W.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    d = rows.withColumns({"_pv": F.last(value, True).over(back), "_pi": F.last(at, True).over(back), "_nv": F.first(value, True).over(ahead), "_ni": F.first(at, True).over(ahead)})
    mid = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * ((F.col(order) - F.col("_pi")) / (F.col("_ni") - F.col("_pi")).cast("double"))
    return d.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_pv").isNull(), F.col("_nv")).when(F.col("_nv").isNull(), F.col("_pv")).otherwise(mid)).drop("_pv", "_pi", "_nv", "_ni")


def median_filter(rows: DataFrame, keys: list[str], order: str, value: str, radius: int = 2) -> DataFrame:
    """Upper median of the window cut off at the ends."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    s = F.sort_array(F.collect_list(value).over(w))
    return rows.withColumn("smooth", F.get(s, F.floor(F.size(s) / 2).cast("int")))


def adaptive_smooth(values: Column, jump: float = 75.0, blend: float = 0.7) -> Column:
    """An array in which a value that is further than ``jump`` from the mean of its neighbours moves to it by ``blend``;
    the left neighbour is the smoothed one, so this is a fold. The ends stay."""
    n = F.size(values)
    step = lambda acc, x: F.when((F.size(acc) == 0) | (F.size(acc) == n - 1), F.concat(acc, F.array(x))).otherwise(F.concat(acc, F.array(_pull(F.element_at(acc, -1), x, F.get(values, F.size(acc) + 1), jump, blend))))
    return F.aggregate(values, F.array().cast("array<double>"), step)


def _pull(left: Column, x: Column, right: Column, jump: float, blend: float) -> Column:
    mean = (left + right) / 2
    return F.when(F.abs(x - mean) > jump, x * (1 - blend) + mean * blend).otherwise(x)


def fill_short_gaps(points: DataFrame, keys: list[str], step: int = 5, most: int = 12) -> DataFrame:
    """``points`` (keys, x, y) with linear values at the missing grid places of gaps of at most ``most`` places."""
    w = W.partitionBy(*keys).orderBy("x")
    d = points.select(*keys, "x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"))
    missing = F.floor((F.col("_x") - F.col("x")) / step) - 1
    gap = d.where((missing >= 1) & (missing <= most)).withColumn("_i", F.explode(F.sequence(F.lit(1), missing.cast("int"))))
    y = F.col("y") + (F.col("_y") - F.col("y")) * (F.col("_i") * step / (F.col("_x") - F.col("x")).cast("double"))
    return points.select(*keys, "x", F.col("y").cast("double").alias("y")).unionByName(gap.select(*keys, (F.col("x") + F.col("_i") * step).alias("x"), y.alias("y")))


def runs(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows with consecutive ``order`` for which ``flag`` holds: first, last, n."""
    on = rows.where(flag)
    g = F.col(order) - F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return on.withColumn("_g", g).groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")


def longest_run(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """The first of the longest runs."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "first", "last")).alias("b")
    return runs(rows, keys, order, flag).groupBy(*keys).agg(best).select(*keys, F.col("b.first").alias("first"), F.col("b.last").alias("last"), (-F.col("b.m")).alias("n"))


def hysteresis_runs(rows: DataFrame, keys: list[str], order: str, value: str, on: float = 0.5, tolerate: int = 5, least: int = 10) -> DataFrame:
    """Stretches of frames at or above ``on`` that bridge at most ``tolerate`` lower frames and last ``least`` frames: sessionization on gaps."""
    w = W.partitionBy(*keys).orderBy(order)
    high = rows.where(F.col(value) >= on).withColumn("_new", F.coalesce((F.col(order) - F.lag(order).over(w) - 1 > tolerate).cast("int"), F.lit(1)))
    high = high.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = high.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_g")
    return out.where(F.col("last") - F.col("first") + 1 >= least)


def ctc_collapse(rows: DataFrame, keys: list[str], order: str, token: str, blank: str) -> DataFrame:
    """Frames whose token differs from the frame before and is no blank, numbered anew."""
    w = W.partitionBy(*keys).orderBy(order)
    prev = F.lag(token).over(w)
    kept = rows.withColumn("_keep", (prev.isNull() | (prev != F.col(token))) & (F.col(token) != blank)).where("_keep")
    return kept.select(*keys, (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col(order).alias("frame"), F.col(token).alias("token"))


def let(value: Column, use) -> Column:
    """use(value), with ``value`` computed once: inside a lambda an expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    e = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(e, lambda e: let(_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def log_softmax(x: Column) -> Column:
    return let(F.array_max(x), lambda top: let(F.log(_sum(F.transform(x, lambda v: F.exp(v - top)))), lambda total: F.transform(x, lambda v: v - top - total)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(x: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def local_mean_cents(salience: Column, threshold: float = 0.03, base: float = 1997.3794084376191, span: float = 7180.0) -> Column:
    """Mean pitch in cents over the nine bins around the largest, weighted by salience; 0 if that is not above the threshold."""
    n = F.size(salience)
    cents = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(span) / (n - 1) + F.lit(base))
    at = argmax(salience)
    lo = F.greatest(F.lit(0), at - 4)
    size = F.least(n - 1, at + 4) - lo + 1
    s, c = F.slice(salience, lo + 1, size), F.slice(cents, lo + 1, size)
    top = F.aggregate(F.zip_with(s, c, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    total = F.aggregate(s, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.array_max(salience) > threshold, top / F.greatest(total, F.lit(1e-8))).otherwise(0.0)


def cents_to_hz(cents: Column) -> Column:
    return F.when(cents > 0, 10 * F.pow(F.lit(2.0), cents / 1200)).otherwise(0.0)


def hz_to_midi(hz: Column) -> Column:
    """Null where there is no pitch."""
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440))


def frame_rms(samples: Column, window: int, hop: int) -> Column:
    """RMS of centered frames, zero beyond the ends: one for each hop, with one more at the end."""
    half = window // 2
    padded = F.concat(F.array_repeat(F.lit(0.0), half), samples.cast("array<double>"), F.array_repeat(F.lit(0.0), half))
    starts = F.sequence(F.lit(0), F.floor((F.size(samples) + 2 * half - window) / hop).cast("int"))
    energy = lambda p, i: F.aggregate(F.slice(p, i * hop + 1, window), F.lit(0.0), lambda a, v: a + v * v)
    return let(padded, lambda p: F.transform(starts, lambda i: F.sqrt(energy(p, i) / window)))


def decibels(rms: Column) -> Column:
    return F.transform(rms, lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-10))))


def overlap_frames(x: Column, size: int) -> Column:
    """Windows of ``size`` that advance by half of it, the last padded with zeros."""
    hop = size // 2
    n = F.greatest(F.lit(1), F.ceil((F.size(x) - size) / hop).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice(x, i * hop + 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.least(F.lit(size), i * hop + size - F.size(x))))))


def repeats_itself(rows: DataFrame, keys: list[str], order: str, token: str, last: int = 15, distinct: int = 3) -> DataFrame:
    """First place from which the last 15 tokens have no more than three distinct values, once there are more than 15."""
    w = W.partitionBy(*keys).orderBy(order)
    d = rows.withColumns({"_k": F.size(F.collect_set(token).over(w.rowsBetween(1 - last, 0))), "_n": F.row_number().over(w)})
    return d.where((F.col("_n") > last) & (F.col("_k") <= distinct)).groupBy(*keys).agg(F.min(order).alias("stopped_at"))


def feature_length(n: Column) -> Column:
    """Encoder frames for mel frames: three halvings of a remainder of 100 and 13 for each whole 100."""
    rest = n % 100
    halves = F.floor((F.floor((F.floor((rest - 1) / 2) + 1 - 1) / 2) + 1 - 1) / 2) + 1
    return (F.when(rest > 0, halves).otherwise(0) + F.floor(n / 100) * 13).cast("bigint")


def pad_block(n: Column, block: int = 100) -> Column:
    return (F.ceil(n / block) * block).cast("bigint")


def mel_points(n: int, low: float, high: float) -> list[float]:
    """Band edges in Hz, evenly spaced on the HTK mel scale."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    a, b = mel(low), mel(high)
    return [700 * (10 ** ((a + (b - a) * k / (n + 1)) / 2595) - 1) for k in range(n + 2)]
