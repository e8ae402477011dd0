"""Grid quantizers that need dynamic programming, per track in vectorized Python.

``simple`` is a window expression (see ``strandline.operators.notes``). ``smart``
chooses durations, ``dp`` decodes phrases under a few shift centers, ``bayes``
decodes gap-separated segments with metrical, duration and motif priors. The decoders
see one track (or one segment) at a time; the driver never sees notes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.operators.notes import quantize_simple
from strandline.runtime import ship


@dataclass(frozen=True)
class Weights:
    """Fixed values of the local cost: asymmetry of start and end shifts, and term weights."""

    start_early: float
    start_late: float
    end_early: float
    end_late: float
    start: float = 0.08971
    end: float = 0.025064
    gap: float = 0.235416 * 0.75
    duration: float = 0.038973
    grid: float = 0.580321
    beat: float = 0.030516


DP = Weights(2.0, 0.5, 1.5, 0.75)
BAYES = Weights(1.4, 0.65, 1.3, 0.9)
BEAT, FINE_GRID = 480, 30


def rint(x: float) -> int:
    return int(np.rint(x))


def to_grid(x: float, step: int) -> int:
    return rint(x / step) * step


def _off(x: np.ndarray, step: int) -> np.ndarray:
    r = np.mod(x, step)
    return np.minimum(r, step - r)


def _pairs(raw: np.ndarray, step: np.ndarray | int, reach: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates of all notes at once: a row for each note, in ascending order; those with end <= start are none."""
    k, step = np.arange(-reach, reach + 1), np.broadcast_to(step, len(raw))[:, None]
    s, e = ((np.rint(raw[:, [j]] / step).astype(np.int64) + k) * step for j in (0, 1))
    return np.repeat(s, len(k), axis=1), np.tile(e, (1, len(k)))


def _shift_cost(s: np.ndarray, e: np.ndarray, raw: np.ndarray, w: Weights) -> np.ndarray:
    """Terms of the local cost that do not look at the previous note; infinite where there is no candidate."""
    start, end = raw[:, [0]], raw[:, [1]]
    pos = lambda x: np.maximum(x, 0)
    cost = (
        w.start * (w.start_early * pos(start - s) + w.start_late * pos(s - start))
        + w.end * (w.end_early * pos(end - e) + w.end_late * pos(e - end))
        + w.duration * np.abs((e - s) - np.maximum(1, end - start))
        + w.grid * _off(s, 120)
        + w.beat * _off(s, BEAT)
    )
    return np.where(e > s, cost, np.inf)


def _decode(raw: np.ndarray, s: np.ndarray, e: np.ndarray, local: np.ndarray, w: Weights, no_overlap: bool) -> tuple[float, np.ndarray]:
    """Least-cost chain of candidates; the first candidate wins ties. Neighbours are tied by the gap term."""
    cost, back = local[0], []
    each = np.arange(local.shape[1])
    for i in range(1, len(raw)):
        gap = s[i][:, None] - e[i - 1][None, :]
        step = cost[None, :] + w.gap * np.abs(gap - (raw[i, 0] - raw[i - 1, 1]))
        if no_overlap:  # predecessors that end in time, if there are any
            fits = (gap >= 0) & np.isfinite(cost)[None, :]
            step = np.where(fits | ~fits.any(1, keepdims=True), step, np.inf)
        back.append(step.argmin(1))
        cost = local[i] + step[each, back[-1]]
    at = int(cost.argmin())
    best, path = float(cost[at]), [at]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    place, path = np.arange(len(raw)), np.array(path[::-1])
    return best, np.stack([s[place, path], e[place, path]], axis=1)


def repair(pairs: np.ndarray, step: int) -> np.ndarray:
    """No start before the previous end; an empty note lasts one grid step."""
    out, last = pairs.copy(), None
    for row in out:
        if last is not None:
            row[0] = max(row[0], last)
        if row[1] <= row[0]:
            row[1] = row[0] + step
        last = row[1]
    return out


# smart ----------------------------------------------------------------------


def smart(raw: np.ndarray, step: int) -> np.ndarray:
    """Durations in plain multiples of the step, close to the sounding ones and to each other; rests are rounded."""
    dur = (raw[:, 1] - raw[:, 0]).astype(float)
    ceiling = np.ceil(dur.max()) + 2 * step
    mult = np.array([m for m in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32) if m * step <= ceiling])
    if not len(mult):
        mult = np.array([1])
    cand = mult * step
    odd = np.where(np.isin(mult, (1, 2, 4, 8, 16)), 0.0, 0.08 * step)
    local = np.abs(dur[:, None] - cand[None, :]) + odd
    change = 0.08 * np.abs(cand[None, :] - cand[:, None])
    cost, back = local[0], []
    for i in range(1, len(dur)):
        total = cost[None, :] + change
        back.append(total.argmin(1))
        cost = local[i] + total[np.arange(len(cand)), back[-1]]
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    chosen = cand[path[::-1]]
    gap = np.maximum(0, raw[1:, 0] - raw[:-1, 1])
    rest = np.where(gap < 0.5 * step, 0, np.rint(gap / step) * step).astype(np.int64)
    start = to_grid(raw[0, 0], step) + np.concatenate([[0], np.cumsum(chosen[:-1] + rest)])
    return np.stack([start, start + chosen], axis=1)


# dp -------------------------------------------------------------------------


def phrases(raw: np.ndarray, lyric: list[str], step: int, longest: int = 16) -> list[slice]:
    """A phrase ends before a gap of a step (30 ticks at least), before any gap between two notes
    that are no ties, or, where notes do not overlap, when it is long enough."""
    cuts = [0]
    for i in range(1, len(raw)):
        gap = raw[i, 0] - raw[i - 1, 1]
        plain = lyric[i] != "-" and lyric[i - 1] != "-"
        if gap >= max(step, 30) or (gap > 0 and plain) or (i - cuts[-1] >= longest and gap >= 0):
            cuts.append(i)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def dp(raw: np.ndarray, lyric: list[str], step: int) -> np.ndarray:
    """Phrases decoded under each shift center; a chain over phrases chooses the centers, at a price for a switch."""
    step = step or FINE_GRID
    centers = (0, 60, 120) if step >= 120 else (0, step // 4, step // 2)
    parts, costs, tracks = phrases(raw, lyric, step), [], []
    s, e = _pairs(raw, step)
    base = _shift_cost(s, e, raw, DP)
    under = [base + _center(s, raw, lyric, [p.start for p in parts], center) for center in centers]
    for part in parts:
        got = [_decode(raw[part], s[part], e[part], u[part], DP, False) for u in under]
        costs.append([g[0] for g in got])
        tracks.append([g[1] for g in got])
    cost, back = np.array(costs[0]), []
    far = np.abs(np.subtract.outer(centers, centers))
    for k in range(1, len(parts)):
        price = np.where(far > 0, 1.0 + 0.08 * far, 0.0) if k >= 2 else np.zeros_like(far, float)
        total = cost[None, :] + price
        back.append(total.argmin(1))
        cost = np.array(costs[k]) + total[np.arange(len(centers)), back[-1]]
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return repair(np.concatenate([tracks[k][c] for k, c in enumerate(reversed(path))]), step)


def _center(s: np.ndarray, raw: np.ndarray, lyric: list[str], firsts: list[int], center: int) -> np.ndarray:
    """Distance of the shift from the center; a late center is rewarded on ties, joined and long notes. ``firsts``: where phrases begin."""
    out = 0.02 * np.abs((s - raw[:, [0]]) - center)
    if center > 0:
        joined = np.concatenate([[True], raw[1:, 0] == raw[:-1, 1]])
        joined[firsts] = True
        bonus = 0.4 * np.array([x == "-" for x in lyric]) + 0.3 * joined + 0.2 * (raw[:, 1] - raw[:, 0] >= 240)
        out = out - (bonus * (1.15 if center >= 120 else 1.0))[:, None]
    return out


# bayes ----------------------------------------------------------------------


def segments(raw: np.ndarray, step: int, longest: int = 48) -> list[slice]:
    cuts = [0]
    for i in range(1, len(raw)):
        if raw[i, 0] - raw[i - 1, 1] >= max(3 * step, 240) or i - cuts[-1] >= longest:
            cuts.append(i)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def metrical(s: np.ndarray, step: int) -> np.ndarray:
    pos = np.mod(s, BEAT)
    out = np.full(s.shape, 0.42)
    for grid, price, fits in ((30, 0.3, step <= 30), (60, 0.2, step <= 60), (120, 0.1, True), (240, 0.04, True), (480, 0.0, True)):
        if fits:
            out[np.mod(pos, grid) == 0] = price
    return out * step


def note_value(dur: np.ndarray, step: int) -> np.ndarray:
    m = np.maximum(1, np.rint(dur / step))
    return np.where(np.isin(m, (1, 2, 4, 8, 16, 32)), 0.0, np.where(np.isin(m, (3, 6, 12, 24)), 0.05, 0.16)) * step


def preferred(raw_dur: int, step: int) -> int | None:
    if raw_dur <= max(1, rint(0.375 * step)):
        return None
    ratio = raw_dur / step
    for top, n in ((1.5, 1), (2.625, 2), (3.375, 3), (4.625, 4), (5.625, 5), (7.0, 6)):
        if ratio <= top:
            return n * step
    return max(step, rint(ratio) * step)


def _near(s: np.ndarray, e: np.ndarray, raw: np.ndarray, step: int) -> np.ndarray:
    """Candidates within the shift limits, or the single nearest of a note: by shift, then by change of duration."""
    a, b = min(max(round(step * 1.0), 60), 180), min(max(round(step * 1.0), 90), 240)
    ds, de = np.abs(s - raw[:, [0]]), np.abs(e - raw[:, [1]])
    some = e > s
    ok = (ds <= a) & (de <= b) & some
    rank = np.where(some, (ds + de) * (1 << 31) + np.abs((e - s) - (raw[:, [1]] - raw[:, [0]])), np.iinfo(np.int64).max)
    single = np.arange(s.shape[1])[None, :] == rank.argmin(1)[:, None]
    return np.where(ok.any(1, keepdims=True), ok, single)


def _phase(raw: np.ndarray, step: int) -> tuple[float, float]:
    """Where the notes of a segment lie against the grid, and how firmly."""
    shift = np.array([to_grid(s, step) - s for s in raw[:, 0]], float)
    center = float(np.median(shift))
    spread = float(np.abs(shift - center).mean())
    firm = max(0.0, 1 - min(spread / (0.4 * step), 1.0))
    phase = np.mod(raw[:, 0], step).astype(float)
    pm = float(np.median(phase))
    p_spread = float(np.abs(phase - pm).mean())
    if len(raw) >= 4 and pm >= 0.5 * step and p_spread <= 0.5 * step:  # consistently late: pull back
        pull = min(pm / step, 1.0)
        return -pm, 0.08 * max(firm, pull)
    return center, 0.03 * firm


def _motifs(raw: np.ndarray, lyric: list[str], step: int, least: int = 6) -> list[tuple[float, float]]:
    """(preferred duration, strength) of each note's motif over the track."""
    dur = np.maximum(1, raw[:, 1] - raw[:, 0])
    gap = np.concatenate([[0], np.maximum(0, raw[1:, 0] - raw[:-1, 1])])
    keys = list(zip(np.maximum(1, np.rint(dur / step)).astype(int).tolist(), np.rint(gap / step).astype(int).tolist(), [x == "-" for x in lyric], strict=True))
    known: dict = {}
    for i, k in enumerate(keys):
        known.setdefault(k, []).append(i)
    out = [(0.0, 0.0)] * len(keys)
    for members in known.values():
        n = len(members)
        if n >= least:
            pref = max(step, to_grid(float(np.median(dur[members])), step))
            for i in members:
                out[i] = (pref, min(0.65, 0.18 + 0.12 * (n - least)))
    return out


def bayes(raw: np.ndarray, lyric: list[str], step: int) -> np.ndarray:
    parts = segments(raw, step)
    center, pull = (np.repeat(x, [p.stop - p.start for p in parts])[:, None] for x in zip(*(_phase(raw[p], step) for p in parts), strict=True))
    pref, strength = (np.array(x, float)[:, None] for x in zip(*_motifs(raw, lyric, step), strict=True))
    dur = np.maximum(1, raw[:, 1] - raw[:, 0])
    short = (step > 30) & (dur <= max(1, rint(0.375 * step)))
    fine = np.where(short, max(30, step // 2), step)
    s, e = _pairs(raw, fine)
    length = e - s
    cost = _shift_cost(s, e, raw, BAYES) + metrical(s, step) + 0.3 * note_value(length, step) + pull * np.abs((s - raw[:, [0]]) - center) + strength * 0.05 * np.abs(length - pref)
    want = [preferred(d, step) for d in dur.tolist()]
    known = np.array([x is not None for x in want])[:, None]
    cost = cost + np.where(known, 0.015 * np.abs(length - np.array([x or 0 for x in want])[:, None]), 0.0)
    cost = np.where(_near(s, e, raw, step), cost, np.inf)
    done = [_decode(raw[p], s[p], e[p], cost[p], BAYES, True)[1] for p in parts]
    return repair(np.concatenate(done), int(min(step, fine.min())))


# dispatch -------------------------------------------------------------------


def quantize_track(raw: np.ndarray, lyric: list[str], mode: str, step: int) -> np.ndarray:
    if not len(raw):
        return raw
    if mode == "smart":
        return smart(raw, step)
    return bayes(raw, lyric, step) if mode == "bayes" else dp(raw, lyric, step)


def quantize(notes: DataFrame, mode: str = "bayes", step: int = 120, tempo: float = 120.0) -> DataFrame:
    """track_id, note_idx, on_tick, off_tick, pitch, lyric. Step 0 leaves notes as they are, except in mode ``dp``."""
    from pyspark.sql import functions as F

    from strandline.schema import ticks

    on = ticks(F.col("onset"), tempo)
    end = F.greatest(on + 1, ticks(F.col("offset"), tempo))
    if step <= 0 and mode != "dp":
        return notes.select("track_id", "note_idx", on.alias("on_tick"), end.alias("off_tick"), "pitch", "lyric")
    if mode not in ("smart", "bayes", "dp"):
        return quantize_simple(notes, step, tempo).select("track_id", "note_idx", "on_tick", "off_tick", "pitch", "lyric")
    ship(notes.sparkSession)
    d = notes.select("track_id", "note_idx", "onset", on.alias("on_tick"), end.alias("off_tick"), "pitch", "lyric")

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["onset", "note_idx"], kind="stable")
        q = quantize_track(pdf[["on_tick", "off_tick"]].to_numpy(np.int64), pdf["lyric"].tolist(), mode, step)
        return pdf.assign(on_tick=q[:, 0], off_tick=q[:, 1])[["track_id", "note_idx", "on_tick", "off_tick", "pitch", "lyric"]]

    return d.groupBy("track_id").applyInPandas(track, "track_id bigint, note_idx bigint, on_tick bigint, off_tick bigint, pitch double, lyric string")
