"""Interval joins and gap operators on half-open [start, end) pairs.

A range predicate alone plans as a nested loop, so joins carry an equi key and cut
time into buckets of ``width``: an interval is copied to each bucket that it
touches, and a pair is kept only in the bucket where the later of the two begins,
so no pair arises twice and nothing needs a distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILLERS = ("SP", "AP", "EP", "br", "sil", "pau", "")


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, l=("start", "end"), r=("r_start", "r_end"), how: str = "inner") -> DataFrame:
    """Pairs that overlap by more than a point. ``how`` is inner or left; column names must differ but for ``keys``."""
    spread = lambda d, s, e, b: d.withColumn(b, F.explode(F.sequence(_bucket(F.col(s), width), F.greatest(_bucket(F.col(s), width), _bucket(F.col(e), width)))))
    a, b = left, right
    if how == "left":
        a = a.withColumn("_row", F.struct(*keys, *l, *[c for c in left.columns if c not in (*keys, *l)]))
    a, b = spread(a, *l, "_lb"), spread(b, *r, "_rb")
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_lb") == F.col("_rb")]
    first = F.col("_lb") == F.greatest(_bucket(F.col(l[0]), width), _bucket(F.col(r[0]), width))
    meet = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    pairs = a.join(b, on, "inner").where(meet & first).drop("_lb", "_rb", *[f"_k_{k}" for k in keys])
    if how == "inner":
        return pairs
    rest = [c for c in right.columns if c not in keys]
    lone = left.join(pairs.select(*[F.col(c).alias(f"_p_{c}") for c in (*keys, *l)]).distinct(), [left[c].eqNullSafe(F.col(f"_p_{c}")) for c in (*keys, *l)], "left_anti")
    return pairs.select(*left.columns, *rest).unionByName(lone.select(*left.columns, *[F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in rest]))


def word_notes(words: DataFrame, notes: DataFrame, keys: list[str], width: float = 4.0, least: float = 1e-4) -> DataFrame:
    """Notes under each word: clipped to it, pieces of ``least`` or less dropped, neighbours of equal
    pitch name joined, the first marked slur 0 and the rest 1. A word without notes, or unvoiced, is one rest.

    ``words``: keys, word_idx, start, end, voiced. ``notes``: keys, n_start, n_end, name."""
    hit = overlap_join(words.where("voiced"), notes.select(*keys, F.col("n_start").alias("r_start"), F.col("n_end").alias("r_end"), "name"), keys, width)
    hit = hit.withColumns({"p_start": F.greatest("start", "r_start"), "p_end": F.least("end", "r_end")}).where(F.col("p_end") - F.col("p_start") > least)
    w = W.partitionBy(*keys, "word_idx").orderBy("p_start", "p_end", "name")
    hit = hit.withColumn("_new", F.coalesce((F.lag("name").over(w) != F.col("name")).cast("int"), F.lit(1)))
    hit = hit.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = hit.groupBy(*keys, "word_idx", "_run").agg(F.min("p_start").alias("p_start"), F.sum(F.col("p_end") - F.col("p_start")).alias("dur"), F.first("name").alias("name"))
    runs = runs.select(*keys, "word_idx", "p_start", "dur", "name", F.when(F.col("_run") == 1, 0).otherwise(1).alias("slur"))
    rests = words.join(runs.select(*keys, "word_idx").distinct(), [*keys, "word_idx"], "left_anti")
    return runs.unionByName(rests.select(*keys, "word_idx", F.col("start").alias("p_start"), (F.col("end") - F.col("start")).alias("dur"), F.lit("rest").alias("name"), F.lit(0).alias("slur")))


def snap(points: DataFrame, marks: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """``points`` (keys, point_idx, t) with the nearest of ``marks`` (keys, mark) within the tolerance, the first on a tie.

    Marks are looked up in the point's bucket and both neighbours; a bucket is as wide as the tolerance."""
    m = marks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("mark"), _bucket(F.col("mark"), tolerance).alias("_mb"))
    p = points.withColumn("_pb", F.explode(F.array(*[_bucket(F.col("t"), tolerance) + d for d in (-1, 0, 1)])))
    near = p.join(m, [*[F.col(k) == F.col(f"_k_{k}") for k in keys], F.col("_pb") == F.col("_mb")]).where(F.abs(F.col("mark") - F.col("t")) <= tolerance)
    best = near.groupBy(*keys, "point_idx").agg(F.min(F.struct(F.abs(F.col("mark") - F.col("t")).alias("d"), "mark"))["mark"].alias("snapped"))
    return points.join(best, [*keys, "point_idx"], "left").withColumn("snapped", F.coalesce("snapped", "t"))


def ordered_boundaries(snapped: DataFrame, keys: list[str], gap: float = 1e-4) -> DataFrame:
    """``snapped`` (keys, point_idx, t, snapped) with ``aligned``: inner boundaries clamped to
    (previous aligned + gap, next raw - gap), the first and last left alone. A fold, because each depends on the one before."""
    rows = F.array_sort(F.collect_list(F.struct("point_idx", "t", "snapped")))
    d = snapped.groupBy(*keys).agg(rows.alias("r"))
    n = F.size("r")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["point_idx"].alias("point_idx"), F.when((F.size(acc) == 0) | (F.size(acc) == n - 1), x["t"]).otherwise(F.least(F.greatest(x["snapped"], F.element_at(acc, -1)["aligned"] + gap), F.get("r", F.size(acc) + 1)["t"] - gap)).alias("aligned"))))
    done = d.select(*keys, F.inline(F.aggregate("r", F.array().cast("array<struct<point_idx:bigint,aligned:double>>"), step)))
    return snapped.join(done, [*keys, "point_idx"])


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], width: float, order: str) -> DataFrame:
    """``points`` (keys, t, ...) in the first of ``intervals`` (keys, start, end, ``order``, ...) that holds them: start <= t < end."""
    iv = intervals.withColumn("_ib", F.explode(F.sequence(_bucket(F.col("start"), width), _bucket(F.col("end"), width))))
    iv = iv.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in iv.columns if c not in keys])
    p = points.withColumn("_tb", _bucket(F.col("t"), width))
    hit = p.join(iv, [*[F.col(k) == F.col(f"_k_{k}") for k in keys], F.col("_tb") == F.col("_ib")]).where("start <= t and t < end")
    rest = F.struct(F.col("start"), F.col(order), *[F.col(c) for c in intervals.columns if c not in (*keys, "start", order)])
    own = [c for c in points.columns]
    return hit.groupBy(*own).agg(F.min(rest).alias("_i")).select(*own, "_i.*")


def nearest_frame(points: DataFrame, series: DataFrame, keys: list[str], step: float, offset: float = 0.0) -> DataFrame:
    """``points`` (keys, t) with the frame of ``series`` (keys, frame_idx, value) nearest to t + offset, clipped to the series: an equi-join on a computed index."""
    last = series.groupBy(*keys).agg(F.max("frame_idx").alias("_last"))
    idx = F.greatest(F.lit(0), F.least(F.col("_last"), F.rint((F.col("t") + offset) / F.lit(step)).cast("bigint")))
    return points.join(last, keys).withColumn("frame_idx", idx).drop("_last").join(series, [*keys, "frame_idx"])


def subtract(new: DataFrame, existing: DataFrame, keys: list[str], width: float, least: float = 0.1) -> DataFrame:
    """What is left of each of ``new`` (keys, new_idx, start, end) without ``existing`` (keys, start, end), pieces of ``least`` or more.

    Existing intervals are merged first; the pieces then lie between neighbours."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    e = existing.select(*keys, "start", "end")
    e = e.withColumn("_new", F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    e = e.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(F.min("start").alias("r_start"), F.max("end").alias("r_end")).drop("_g")
    hit = overlap_join(new, e, keys, width, how="left")
    v = W.partitionBy(*keys, "new_idx").orderBy("r_start")
    before = hit.select(*keys, "new_idx", F.coalesce(F.lag("r_end").over(v), F.col("start")).alias("p_start"), F.coalesce(F.col("r_start"), F.col("end")).alias("p_end"))
    after = hit.where("r_end is not null").groupBy(*keys, "new_idx").agg(F.max("r_end").alias("p_start"), F.first("end").alias("p_end"))
    return before.unionByName(after).where(F.col("p_end") - F.col("p_start") >= least)


def fill_small_gaps(words: DataFrame, length: DataFrame, keys: list[str], gap: float = 0.1) -> DataFrame:
    """The first word reaches back to 0 and the last on to the end if that is no more than ``gap``; inner gaps of at most ``gap`` close."""
    w = W.partitionBy(*keys).orderBy("start")
    d = words.join(length, keys)
    nxt = F.lead("start").over(w)
    start = F.when(F.lag("end").over(w).isNull() & (F.col("start") > 0) & (F.col("start") <= gap), F.lit(0.0)).otherwise(F.col("start"))
    end = F.when(nxt.isNull() & (F.col("length") - F.col("end") <= gap), F.greatest("end", "length")).when((nxt > F.col("end")) & (nxt - F.col("end") <= gap), nxt).otherwise(F.col("end"))
    return d.withColumns({"f_start": start, "f_end": end})


def tile(words: DataFrame, length: DataFrame, keys: list[str], mark: str = "SP") -> DataFrame:
    """``words`` (keys, start, end, text) with a ``mark`` in every gap: a tiling of [0, length]."""
    w = W.partitionBy(*keys).orderBy("start")
    prev = F.coalesce(F.lag("end").over(w), F.lit(0.0))
    inner = words.select(*keys, prev.alias("s"), F.col("start").alias("e"))
    tail = length.join(words.groupBy(*keys).agg(F.max("end").alias("s")), keys, "left").select(*keys, F.coalesce("s", F.lit(0.0)).alias("s"), F.col("length").alias("e"))
    gaps = inner.unionByName(tail).where("e > s").select(*keys, F.col("s").alias("start"), F.col("e").alias("end"), F.lit(mark).alias("text"))
    return words.select(*keys, "start", "end", "text").unionByName(gaps)


def merge_runs(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Neighbouring rows for which ``flag`` holds become one (durations add up); the others stay. ``rows``: keys, order, dur."""
    w = W.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("_f", flag.cast("int"))
    d = d.withColumn("_new", F.when((F.col("_f") == 1) & (F.lag("_f").over(w) == 1), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*keys, F.col("_run").alias("run")).agg(F.sum("dur").alias("dur"), F.first("_f").alias("flag"), F.count("*").alias("n"))


def short_words(words: DataFrame, keys: list[str], ratio: float = 0.6, portion: float = 0.15, least_k: int = 3) -> DataFrame:
    """Lexical words that are among the k shortest, and shorter than ``ratio`` of both lexical neighbours,
    before a gap to the next: the candidates of boundary repair (durations as they came)."""
    lex = words.where(~F.col("text").isin(*FILLERS)).withColumn("dur", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    w = W.partitionBy(*keys).orderBy("start")
    n = F.count("*").over(W.partitionBy(*keys))
    d = lex.withColumns({"prev_dur": F.lag("dur").over(w), "next_dur": F.lead("dur").over(w), "next_start": F.lead("start").over(w), "_n": n, "_rank": F.row_number().over(W.partitionBy(*keys).orderBy("dur", "start"))})
    k = F.greatest(F.lit(least_k), F.floor(F.col("_n") * portion + 0.999999))
    low = F.least("prev_dur", "next_dur")
    ok = (F.col("_n") >= 3) & (F.col("_rank") <= k) & (low > 0) & (F.col("dur") < low * ratio) & (F.col("next_start") > F.col("end"))
    return d.where(ok).drop("_n", "_rank")


def overlapping(words: DataFrame, new: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Those of ``new`` that overlap no row of ``words``: the static form of the guarded insert."""
    hit = overlap_join(new, words.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, width)
    return new.join(hit.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


def check_tiling(words: DataFrame, keys: list[str]) -> DataFrame:
    """First violation of each key: start of a row that is not the end of the one before, or not before its own end."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    d = words.withColumn("_bad", F.when(F.col("start") >= F.col("end"), "empty").when(F.lag("end").over(w) != F.col("start"), "not contiguous"))
    return d.where("_bad is not null").groupBy(*keys).agg(F.min(F.struct("start", "_bad")).alias("v")).select(*keys, F.col("v.start").alias("at"), F.col("v._bad").alias("problem"))
