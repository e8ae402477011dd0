from __future__ import annotations

import math
import random

import numpy as np
import pytest

from strandline.operators import grid, intervals, notes, quantize, stats
from strandline.schema import ticks

NOTE = "track_id bigint, note_idx bigint, onset double, offset double, pitch double, lyric string"


def make(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), float(p), ly) for i, (a, b, p, ly) in enumerate(rows)], NOTE)


def test_only_valid_notes_stay(spark):
    d = make(spark, [(0.0, 0.5, 200.0, "hi"), (0.6, 0.4, 60.0, "bad"), (0.7, 1.0, float("nan"), "nan"), (0.0, 0.5, -12.0, "low"), (0.0, float("inf"), 60.0, "inf")])
    rows = notes.valid_notes(d).select("lyric", notes.midi_note(d["pitch"]).alias("m"), notes.note_name(d["pitch"]).alias("n")).collect()
    assert [(r["lyric"], r["m"]) for r in rows] == [("hi", 127), ("low", 0)]
    assert notes.reject_counts(d).first()["rejected"] == 3


def test_note_names_go_round(spark):
    d = spark.createDataFrame([(float(p) / 100,) for p in range(0, 12700, 37)], "p double")
    for r in d.select("p", notes.name_pitch(notes.note_name(d["p"], True)).alias("q")).collect():
        assert abs(r["p"] - r["q"]) < 1e-9
    assert d.limit(1).select(notes.note_name(d["p"] + 60).alias("n")).first()["n"] == "C4"


def test_ticks_round_half_to_even(spark):
    d = spark.createDataFrame([(0.5 / 960,), (1.5 / 960,), (2.5 / 960,)], "t double")
    assert [r["k"] for r in d.select(ticks(d["t"]).alias("k")).collect()] == [0, 2, 2]


def simple_rule(raw, step):
    """Onsets one after the other, each at least a step after the one before."""
    out = []
    for on, _ in raw:
        x = int(np.rint(on / step)) * step
        out.append(max(x, out[-1] + step) if out else x)
    return out


def test_simple_quantizer_is_the_sequential_rule(spark):
    r = random.Random(1)
    at = sorted(r.randint(0, 4000) for _ in range(120))
    d = make(spark, [(a / 960, (a + r.randint(10, 300)) / 960, 60, "la") for a in at])
    got = notes.quantize_simple(d).orderBy("note_idx").toPandas()
    assert got["on_tick"].tolist() == simple_rule([(a, 0) for a in at], 120)
    assert (got["off_tick"] > got["on_tick"]).all() and (got["off_tick"].to_numpy()[:-1] <= got["on_tick"].to_numpy()[1:]).all()


def test_overlap_repair_is_the_fold(spark):
    r = random.Random(2)
    rows = sorted((r.randint(0, 40) * 120, r.randint(-1, 5) * 120) for _ in range(80))
    pairs = [(a, a + n) for a, n in rows]
    d = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "track_id bigint, note_idx bigint, q_start bigint, q_end bigint")
    got = notes.repair_overlaps_on_grid(d).orderBy("note_idx").select("fixed_start", "fixed_end").toPandas().to_numpy()
    assert (got == quantize.repair(np.array(pairs), 120)).all()


def test_segments_are_the_sequential_rule(spark):
    r, at, raw = random.Random(3), 0, []
    for _ in range(300):
        at += r.choice([0, 0, 0, 10, 400])
        raw.append((at, at + 100))
        at += 100
    d = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(raw)], "track_id bigint, note_idx bigint, raw_start bigint, raw_end bigint")
    got = [x["segment"] for x in notes.with_segments(notes.with_gap(d)).orderBy("note_idx").collect()]
    hard, seg, n = [], -1, 0
    for i in range(len(raw)):
        if i == 0 or raw[i][0] - raw[i - 1][1] >= 360 or n == 48:
            seg, n = seg + 1, 0
        hard.append(seg)
        n += 1
    assert got == hard


CASES = [
    ([(70, 180), (270, 380), (470, 640)], [(0, 120), (240, 360), (480, 600)]),
    ([(85, 205), (205, 325), (325, 445)], [(120, 240), (240, 360), (360, 480)]),
    ([(62401, 62413)], [(62400, 62460)]),
    ([(142313, 142464), (142464, 142776)], [(142320, 142560), (142560, 142800)]),
    ([(8166, 8480)], [(8160, 8400)]),
    ([(16635, 17127), (17127, 17598), (17598, 17684), (17684, 17823), (17823, 18076), (18076, 18719)], [(16560, 17040), (17040, 17520), (17520, 17640), (17640, 17760), (17760, 18000), (18000, 18720)]),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_bayes_ticks(raw, want):
    assert [tuple(x) for x in quantize.bayes(np.array(raw), ["la"] * len(raw), 120).tolist()] == want


def test_bayes_durations_and_phrase_quantizer():
    got = quantize.bayes(np.array([(0, 110), (125, 235), (250, 420)]), ["a", "b", "c"], 120)
    assert (got[:, 1] - got[:, 0]).tolist() == [120, 120, 120]
    for raw, step, grid_ in (([(73, 221), (226, 407), (430, 701)], 120, 120), ([(120, 240)], 120, 120), ([(120, 240)], 240, 240), ([(113, 291)], 0, 30)):
        q = quantize.dp(np.array(raw), ["la", "-", "li"][: len(raw)], step)
        assert (q % grid_ == 0).all() and (q[:, 1] > q[:, 0]).all() and (q[:-1, 1] <= q[1:, 0]).all()
    assert quantize.dp(np.array([(120, 240)]), ["la"], 120).tolist() == [[120, 240]]


@pytest.mark.parametrize("mode", ["simple", "smart", "dp", "bayes"])
def test_quantizers_on_random_tracks(spark, mode):
    r, rows = random.Random(5), []
    for t in range(6):
        at = 0.0
        for i in range(40):
            at += r.choice([0, 0, 0.02, 0.4])
            d = r.uniform(0.05, 1.0)
            rows.append((t, i, at, at + d, 60.0, r.choice(["la", "-"])))
            at += d
    d = spark.createDataFrame(rows, NOTE)
    got = quantize.quantize(d, mode).toPandas().sort_values(["track_id", "note_idx"])
    assert len(got) == len(rows)
    for _, g in got.groupby("track_id"):
        assert (g["off_tick"] > g["on_tick"]).all() and (g["off_tick"].to_numpy()[:-1] <= g["on_tick"].to_numpy()[1:]).all()
        if mode != "bayes":
            assert (g["on_tick"] % 120 == 0).all()
    same = quantize.quantize(d, "bayes", 0).toPandas()
    assert len(same) == len(rows) and ((same["on_tick"] % 120) != 0).any()


def test_penalties(spark):
    d = spark.createDataFrame([(0, 120), (240, 360), (120, 45), (60, 46), (30, 2000)], "s bigint, n bigint")
    rows = d.select(grid.metrical_penalty(d["s"], 120).alias("m"), grid.note_value_penalty(d["n"], 120).alias("v"), grid.preferred_duration(d["n"], 120).alias("p")).collect()
    assert [round(r["m"], 6) for r in rows] == [0.0, 4.8, 12.0, 50.4, 50.4]
    assert [r["p"] for r in rows] == [quantize.preferred(n, 120) for n in (120, 360, 45, 46, 2000)]
    assert [round(r["v"], 6) for r in rows] == [round(float(quantize.note_value(np.array([n]), 120)[0]), 6) for n in (120, 360, 45, 46, 2000)]


def test_interval_joins_equal_nested_loops(spark):
    r = random.Random(6)
    iv = lambda n: [(r.randint(0, 2), a := r.uniform(0, 30), a + r.uniform(0.01, 6)) for _ in range(n)]
    a, b = iv(60), iv(60)
    da = spark.createDataFrame([(*x, i) for i, x in enumerate(a)], "k int, start double, end double, i int")
    db = spark.createDataFrame([(*x, i) for i, x in enumerate(b)], "k int, r_start double, r_end double, j int")
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    for width in (0.5, 4.0, 100.0):
        got = [(x["i"], x["j"]) for x in intervals.overlap_join(da, db, ["k"], width).collect()]
        assert sorted(got) == sorted(want)
    left = intervals.overlap_join(da, db, ["k"], 2.0, how="left").collect()
    assert {x["i"] for x in left if x["j"] is None} == {i for i in range(60)} - {i for i, _ in want} and len(left) == len(want) + sum(x["j"] is None for x in left)
    pts = [(r.randint(0, 2), r.uniform(0, 30)) for _ in range(80)]
    dp = spark.createDataFrame(pts, "k int, t double")
    di = da.select("k", "start", "end", "i")
    got = {(x["k"], x["t"]): x["i"] for x in intervals.points_in(dp, di, ["k"], 2.0, "i").collect()}
    want = {}
    for k, t in pts:
        hits = [(x[1], i) for i, x in enumerate(a) if x[0] == k and x[1] <= t < x[2]]
        if hits:
            want[(k, t)] = min(hits)[1]
    assert got == want


def test_tiling_covers_everything(spark):
    w = spark.createDataFrame([(1, 0.2, 0.5, "a"), (1, 0.5, 0.9, "b"), (1, 1.2, 1.5, "c")], "k int, start double, end double, text string")
    length = spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, length double")
    t = intervals.tile(w, length, ["k"]).orderBy("k", "start").collect()
    assert [(x["start"], x["end"], x["text"]) for x in t] == [(0.0, 0.2, "SP"), (0.2, 0.5, "a"), (0.5, 0.9, "b"), (0.9, 1.2, "SP"), (1.2, 1.5, "c"), (1.5, 2.0, "SP"), (0.0, 1.0, "SP")]
    assert intervals.check_tiling(intervals.tile(w, length, ["k"]), ["k"]).count() == 0
    cut = intervals.subtract(spark.createDataFrame([(1, 0, 0.0, 2.0)], "k int, new_idx int, start double, end double"), w, ["k"], 1.0)
    assert sorted((round(x["p_start"], 9), round(x["p_end"], 9)) for x in cut.collect()) == [(0.0, 0.2), (0.9, 1.2), (1.5, 2.0)]


def test_ordered_boundaries_is_the_fold(spark):
    t, s = [0.0, 1.0, 1.5, 2.0, 3.0], [0.3, 1.008, 1.0, 2.005, 3.1]
    d = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(t, s, strict=True))], "k int, point_idx bigint, t double, snapped double")
    got = [x["aligned"] for x in intervals.ordered_boundaries(d, ["k"]).orderBy("point_idx").collect()]
    want = [t[0]]
    for i in range(1, 4):
        want.append(min(max(s[i], want[-1] + 1e-4), t[i + 1] - 1e-4))
    assert np.allclose(got, [*want, t[4]])


def test_robust_mean_and_majority(spark):
    d = spark.createDataFrame([(1, x) for x in (1.0, 1.1, 0.9, 1.0, 9.0)] + [(2, 3.0), (2, 3.0)], "k int, v double")
    got = {r["k"]: r for r in stats.robust_mean(d, ["k"], "v").collect()}
    dev = sorted(abs(x - 1.0) for x in (1.0, 1.1, 0.9, 1.0, 9.0))[2]
    kept = [x for x in (1.0, 1.1, 0.9, 1.0, 9.0) if abs(x - 1.0) / (1.4826 * dev) <= 1.5]
    assert math.isclose(got[1]["robust"], sum(kept) / len(kept)) and got[2]["robust"] == 3.0
    m = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b", "c"]), (1, 2, ["b", "c"]), (1, 3, ["a"])], "k int, o int, p array<string>")
    assert stats.majority(m, ["k"], "p", "o").first()["p"] == ["b", "c"]
    b = spark.createDataFrame([(1, p, i, i + 0.01 * p, i + 1.0 + 0.01 * p) for p in range(3) for i in range(4)], "utt int, pass int, ph_idx bigint, start double, end double")
    got = stats.consolidate(b, ["utt"]).orderBy("ph_idx").toPandas()
    assert (got["end"] > got["start"]).all() and (got["start"].to_numpy()[1:] >= got["end"].to_numpy()[:-1] - 1e-9).all()
