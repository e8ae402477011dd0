"""Grid candidates and the penalties of the quantizers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.operators.series import let


def grid_distance(x: Column, step: int) -> Column:
    r = F.pmod(x, F.lit(step))
    return F.least(r, step - r)


def candidates(raw: Column, step: int, reach: int = 3) -> Column:
    """Grid lines within ``reach`` steps of the nearest."""
    center = F.rint(raw / F.lit(float(step))).cast("bigint")
    return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: (center + k) * step)


def nearest(values: Column, x: Column) -> Column:
    """The nearest of an array, the first on a tie."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"), v.alias("v"))))["v"]


def candidate_pairs(start: Column, end: Column, step: int) -> Column:
    """(s, e) with e > s, sorted."""
    pairs = lambda ends: F.flatten(F.transform(candidates(start, step), lambda s: F.transform(F.filter(ends, lambda e: e > s), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    return F.array_sort(let(candidates(end, step), pairs))


def shift_limits(step: int) -> tuple[int, int]:
    near = round(step * 1.0)
    return min(max(near, 60), 180), min(max(near, 90), 240)


def within_shift(pairs: Column, start: Column, end: Column, step: int) -> Column:
    """Pairs within the shift limits; if there is none, the one with the least shift, then the least change of duration."""
    a, b = shift_limits(step)
    ok = F.filter(pairs, lambda p: (F.abs(p["s"] - start) <= a) & (F.abs(p["e"] - end) <= b))
    cost = lambda p: F.struct((F.abs(p["s"] - start) + F.abs(p["e"] - end)).alias("shift"), F.abs((p["e"] - p["s"]) - (end - start)).alias("dur"), p["s"].alias("s"), p["e"].alias("e"))
    best = F.array_min(F.transform(pairs, cost))
    return F.when(F.size(ok) > 0, ok).otherwise(F.array(F.struct(best["s"].alias("s"), best["e"].alias("e"))))


def metrical_penalty(tick: Column, step: int) -> Column:
    at = lambda n: F.pmod(tick, F.lit(n)) == 0
    c = F.when(at(480), 0.0).when(at(240), 0.04 * step).when(at(120), 0.1 * step)
    if step <= 60:
        c = c.when(at(60), 0.2 * step)
    if step <= 30:
        c = c.when(at(30), 0.3 * step)
    return c.otherwise(0.42 * step)


def note_value_penalty(dur: Column, step: int) -> Column:
    m = F.greatest(F.lit(1), F.rint(dur / F.lit(float(step)))).cast("bigint")
    return F.when(m.isin(1, 2, 4, 8, 16, 32), 0.0).when(m.isin(3, 6, 12, 24), 0.05 * step).otherwise(0.16 * step)


def preferred_duration(raw: Column, step: int) -> Column:
    """Null for short notes; else a whole number of steps by ratio."""
    r = raw / F.lit(float(step))
    c = F.when(raw <= max(1, round(0.375 * step)), None)
    for top, n in ((1.5, 1), (2.625, 2), (3.375, 3), (4.625, 4), (5.625, 5), (7.0, 6)):
        c = c.when(r <= top, n * step)
    return c.otherwise(F.greatest(F.lit(step), F.rint(r) * step)).cast("bigint")


def duration_candidates(longest: Column, step: int) -> Column:
    """Multiples 1 2 3 4 6 8 12 16 24 32 of the step up to the longest and two steps more."""
    return F.filter(F.array(*[F.lit(m * step) for m in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)]), lambda c: c <= F.ceil(longest) + 2 * step)
