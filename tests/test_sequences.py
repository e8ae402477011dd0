from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import codecs, itn, kana, text
from strandline.operators import decoding, matching, series, slicing, stats
from strandline.plans import pipeline, sequence_queries, text_queries


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_distances_equal_the_plain_tables():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert matching.edit_distance(a, b) == lev(a, b)
        assert matching.lcs_length(a, b) == lcs(a, b)
        cost, pairs = matching.align(a, b)
        assert cost == lev(a, b) == sum(i is None or j is None or a[i] != b[j] for i, j in pairs)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert len(matching.matched_pairs(a, b)) == lcs(a, b)


def plain_edits(p, q):
    """The rule cell by cell."""
    n = min(len(p), len(q))
    t = [[2 * j if not i else i for j in range(n + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            new = t[i][j - 1] + (1 if j > 1 and q[j - 1][1] == q[j - 2][1] else 2)
            kept = t[i - 1][j - 1] + (p[i - 1][1] != q[j - 1][1]) + (1 <= abs(p[i - 1][0] - q[j - 1][0]) < 2)
            t[i][j] = min(new, t[i - 1][j] + 1, kept)
    return t[n][n], 2 * n


def plain_pairs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_boundary_edits_and_matched_pairs(spark, sf):
    r = random.Random(4)
    tier = lambda: [(r.choice([0, 0.5, 1, 1.5, 2, 3]) + k, r.choice("ab")) for k in range(r.randint(0, 9))]
    for _ in range(400):
        p, q = tier(), tier()
        assert matching.edit_counts(p, q) == plain_edits(p, q)
        a, b = [m for _, m in p], [m for _, m in q]
        assert matching.matched_pairs(a, b) == plain_pairs(a, b)
    turns = {(x["conv_id"], x["turn"]): (x["a"], x["b"]) for x in text_queries._turns(spark, sf).collect()}
    got = {}
    for x in catalog.QUERIES["matched_pairs"](spark, sf).collect():
        got.setdefault((x["conv_id"], x["turn"]), []).append((x["i"], x["j"]))
    assert all(sorted(got.get(k, [])) == plain_pairs(*ab) for k, ab in turns.items())
    notes = {}
    for x in sequence_queries.notes_of(spark, sf).orderBy("track_id", "note_idx").collect():
        notes.setdefault(x["track_id"], []).append((x["onset"], x["lyric"]))
    for x in catalog.QUERIES["edit_counts"](spark, sf).collect():
        n = notes[x["track_id"]]
        assert (x["edits"], x["most"]) == plain_edits([(t * 50, m) for t, m in n], [(float(np.rint(t * 8)) / 8 * 50, m) for t, m in n])


def test_matches():
    ref = list("the quick brown fox jumps".replace(" ", "_"))
    m = matching.match(list("brown"), ref, ref)
    assert m["exact"] and (m["start"], m["end"]) == (10, 15)
    m = matching.match(list("brwnn"), ref, ref)
    assert m["found"] and not m["exact"] and m["distance"] > 0
    assert matching.match([], ref, ref)["reason"] == "empty input" and not matching.match(list("ZZZ"), ref, ref)["found"]
    assert matching.highlight(["a", "x", "c"], ["a", "b", "c"], ["A", "B", "C"]) == ("a (x) c", "a (b) c", "A (B) C", 1)
    assert matching.highlight(["-", "a"], ["a"], ["A"]) == ("(-) a", "a", "A", 1)


def test_exact_place_as_expression(spark):
    d = spark.createDataFrame([(list("abcabd"), list("abd")), (list("abc"), list("x")), (list("a"), list("ab")), (list("aab"), [])], "r array<string>, q array<string>")
    assert [x["p"] for x in d.select(matching.find_exact(F.col("r"), F.col("q")).alias("p")).collect()] == [3, -1, -1, -1]
    rows = spark.createDataFrame([(list("aab"), list("abb"))], "a array<string>, b array<string>").select(stats.token_overlap(F.col("a"), F.col("b")).alias("o"), stats.difference_count(F.col("a"), F.col("b")).alias("d")).first()
    assert rows["o"] == 2 and rows["d"] == 1


def best_path_score(lp, edge, phones):
    """Every path by recursion: the best score at the end states."""
    s, t = lp.shape
    quiet = [p == 0 for p in phones]
    out = {}

    def go(k, at, score, peak):
        if k == t:
            out[at] = max(out.get(at, -np.inf), score)
            return
        stay, leave = np.log(1 - edge[k] + 1e-6), np.log(edge[k] + 1e-6)
        go(k + 1, at, score + lp[at, k] + stay, 0.0 if quiet[at] else max(peak, lp[at, k]))
        for jump in (1, 2):
            if at + jump < s and (jump == 1 or quiet[at + 1] or at + 1 >= s - 1):
                to = at + jump
                go(k + 1, to, score + lp[at, k] + leave + peak * t / s, 0.0 if quiet[to] else lp[to, k])

    go(1, 0, lp[0, 0], 0.0 if quiet[0] else lp[0, 0])
    if s > 1 and quiet[0]:
        go(1, 1, lp[1, 0], 0.0 if quiet[1] else lp[1, 0])
    return out


def test_forced_path_is_monotone_and_scores_add_up():
    r = np.random.default_rng(2)
    for _ in range(20):
        lp = decoding.log_softmax(r.normal(size=(4, 7)))
        edge = r.uniform(0.05, 0.9, 7)
        phones = np.array([0, 3, 2, 0])
        path, score = decoding.forced_path(lp, edge, phones)
        assert (np.diff(path) >= 0).all() and (np.diff(path) <= 2).all() and path[-1] in (2, 3)
        assert score[-1] <= max(best_path_score(lp, edge, phones).values()) + 1e-9


def test_collapse():
    assert decoding.collapse_ids([1, 1, 0, 1, 2, 2, 9], {1: "a", 2: "b"}) == ["a", "a", "b", "<unk>"]
    assert decoding.best_path(np.eye(3)[[1, 1, 0, 2]], {1: "a", 2: "b"}) == ["a", "b"]


def test_series(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])], "k int, i int, v double")
    assert [r["filled"] for r in series.fill_linear(d, ["k"], "i", "v").orderBy("i").collect()] == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    x = [0.0, 10.0, 500.0, 20.0, 30.0]
    got = spark.createDataFrame([(x,)], "v array<double>").select(series.adaptive_smooth(F.col("v")).alias("s")).first()["s"]
    want = list(x)
    for i in range(1, 4):
        mean = (want[i - 1] + want[i + 1]) / 2
        want[i] = want[i] * 0.3 + mean * 0.7 if abs(want[i] - mean) > 75 else want[i]
    assert np.allclose(got, want)
    v = [1.0, 3.0, 2.0]
    s, ls = spark.createDataFrame([(v,)], "v array<double>").select(series.softmax(F.col("v")), series.log_softmax(F.col("v"))).first()
    e = np.exp(v) / np.exp(v).sum()
    assert np.allclose(s, e) and np.allclose(ls, np.log(e))
    wave = np.sin(np.arange(200) * 0.2).tolist()
    got = spark.createDataFrame([(wave,)], "v array<double>").select(series.frame_rms(F.col("v"), 32, 16).alias("r")).first()["r"]
    assert np.allclose(got, slicing.rms(np.array(wave), 32, 16))


def test_salience_of_one_bin(spark):
    one = np.zeros(360)
    one[100] = 1.0
    d = spark.createDataFrame([(one.tolist(),), (np.zeros(360).tolist(),)], "s array<double>")
    rows = d.select(series.local_mean_cents(F.col("s")).alias("c")).select("c", series.hz_to_midi(series.cents_to_hz(F.col("c"))).alias("m")).collect()
    assert abs(rows[0]["c"] - (100 * 7180 / 359 + 1997.3794084376191)) < 1e-9 and rows[1]["c"] == 0.0 and rows[1]["m"] is None


def test_turn_edit_distance_compares_whole_turns(spark, tmp_path):
    long = [f"wort{i}" for i in range(60)]
    turns = [long, [*long[:-1], "ändern", "più"], ["a"], []]
    spark.createDataFrame([(1, k, "u", " ".join(t)) for k, t in enumerate(turns)] + [(2, 0, "u", "alone")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalog.QUERIES["turn_edit_distance"](spark, str(tmp_path)).collect()))
    assert got == [(1, k, lev(turns[k], turns[k + 1])) for k in range(3)] == [(1, 0, 2), (1, 1, 61), (1, 2, 1)]


def test_window_match_takes_any_run_of_an_item(spark, tmp_path):
    item = "one two three four five six seven eight nine ten".split()
    docs = {1: ["x", *item[3:], "y"], 2: [*item[:2], "drei", *item[3:]], 3: ["so", "ho", "hum", "so"], 4: ["one", "two", "three", "four", "nothing"], 5: None}
    spark.createDataFrame([(d, None if w is None else " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(10, " ".join(item)), (11, "ho hum"), (12, "never found in any of these"), (13, ""), (14, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["item_id"], r["doc_id"]): (r["found"], r["exact"], r["distance"]) for r in catalog.QUERIES["window_match"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(10, 1), (10, 2), (11, 3)}
    assert got[11, 3] == (True, True, 0) and got[10, 2] == (True, False, 1) and got[10, 1][0]
    assert tuple(catalog.QUERIES["match_counters"](spark, str(tmp_path)).first()) == (6, 3, 0, 3)


def test_waves_reach_to_the_last_offset(spark, tmp_path):
    """A track of more than half a minute: notes and cuts after it count."""
    at = [0.0, 1.0, 2.0, 40.0, 41.0, 60.0]
    rows = [(k, 7, "click", 1.0, '{"k": 100}', t) for k, t in enumerate(at)]
    d = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string, s double")
    d.selectExpr("event_id", "user_id", "event_type", "value", "props", "timestamp_micros(cast(s * 60000 * 1000000 as bigint)) as ts").write.parquet(f"{tmp_path}/events.parquet")
    notes = sequence_queries.notes_of(spark, str(tmp_path)).collect()
    assert max(n["onset"] for n in notes) > 30
    wave = sequence_queries._waves(spark, str(tmp_path)).first()["samples"]
    assert len(wave) == int(max(n["offset"] for n in notes) * 1000)
    assert all(np.any(wave[int(n["onset"] * 1000) : int(n["offset"] * 1000)]) for n in notes)
    for name in ("silence_slicer", "smart_slicer"):
        assert max(r["offset"] + r["n_samples"] / 1000 for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) > 60


def test_silence_slicer():
    sr = 1000
    tone = lambda s: np.sin(np.arange(int(s * sr)) * 0.5).astype(np.float32)
    x = np.concatenate([tone(6), np.zeros(sr, np.float32), tone(6), np.zeros(2 * sr, np.float32)])
    chunks = slicing.Silence(min_length=5000, max_kept=200).chunks(x, sr)
    assert len(chunks) == 2 and chunks[0][0] == 0.0 and 6.0 <= chunks[1][0] <= 7.0
    for off, part in chunks:
        assert np.array_equal(part, x[round(off * sr) : round(off * sr) + len(part)])
    assert len(slicing.Silence().chunks(x[:4000], sr)) == 1
    long = tone(30)
    long[9_000:9_300] = 0
    parts = slicing.window_split(long, sr, 5, 12, window=64, hop=16)
    assert all(len(p) <= 12 * sr + 64 for _, p in parts) and sum(len(p) for _, p in parts) >= len(long) - len(parts)
    merged = slicing.merge_short([(0.0, tone(1)), (1.5, tone(1)), (3.0, tone(5)), (9.0, tone(0.5))], sr, 3, 9)
    assert sum(len(p) for _, p in merged) >= 7_500 and len(merged) < 4
    assert slicing.longest_true(np.array([0, 1, 1, 0, 1, 1])) == (1, 3)


def test_merge_tiny(spark):
    d = spark.createDataFrame([([0.1, 0.2, 1.0, 0.1, 2.0, 0.3],), ([0.1, 0.1],), ([],)], "d array<double>")
    got = [r["m"] for r in d.select(slicing.merge_tiny(F.col("d")).alias("m")).collect()]
    assert np.allclose(got[0], [1.4, 2.3]) and np.allclose(got[1], [0.2]) and got[2] == []


@pytest.mark.parametrize("kind", list(codecs.ENCODE))
def test_codecs_are_stable(kind):
    x = np.random.default_rng(3).normal(size=1024).astype(np.float32)
    raw = codecs.quantize(x, kind)
    assert len(raw) == codecs.byte_shape((1024,), kind)[0] and codecs.value_shape((len(raw),), kind) == (1024,)
    y = codecs.dequantize(raw, kind)
    assert codecs.quantize(y, kind) == raw
    assert np.abs(x - y).max() <= {"BF16": 0.02, "Q8_0": 0.02, "Q5_1": 0.12, "Q5_0": 0.15, "Q4_1": 0.22, "Q4_0": 0.3, "MXFP4": 1.0}.get(kind, 2.1)
    assert (codecs.dequantize(codecs.quantize(np.zeros(1024, np.float32), kind), kind) == 0).all()


@pytest.mark.parametrize("kind", [k for k in codecs.DECODE if k not in codecs.ENCODE])
def test_decoders_are_linear_in_the_scale(kind):
    n, size = codecs.SIZES[kind]
    raw = np.random.default_rng(4).integers(0, 50, size, dtype=np.uint8)
    at = {"Q2_K": (80, 82), "Q3_K": (108,), "Q4_K": (0, 2), "Q5_K": (0, 2), "Q6_K": (208,), "IQ4_NL": (0,), "IQ4_XS": (0,)}[kind]
    out = []
    for scale in (1.0, 2.0):
        b = raw.copy()
        for k in at:
            b[k : k + 2] = np.array([scale], "<f2").view(np.uint8)
        out.append(codecs.dequantize(b.tobytes(), kind))
    assert len(out[0]) == n and np.allclose(out[0] * 2, out[1]) and out[0].any()


def test_moras_and_numbers():
    assert [r for _, r in kana.mora_pairs("キャット")] == ["kya", "cl", "to"]
    assert [r for _, r in kana.mora_pairs("ラーメンー")] == ["ra", "a", "me", "n"]
    assert kana.MORAS["シェ"] == "she" and kana.KANA_OF["ji"] == "じ" and kana.MORAS["ヴォ"] == "vo" and kana.MORAS["ファ"] == "fa"
    for t, want in (("二百五", "250"), ("一千零二十", "1020"), ("五十米", "50米"), ("三百五六", "350~360"), ("十五六", "15~16"), ("十二月三号", "12月3号"), ("三五百人", "300~500人"), ("我有三十六计", "我有三十六计"), (None, None), ("", "")):
        assert itn.to_digits(t) == want


def spans(spark, words, chars, language):
    """words: (text, start, end, [(phone, start), ...]) of one utterance."""
    w = spark.createDataFrame([(1, i, float(a), float(z), t) for i, (t, a, z, _) in enumerate(words)], "utt int, word_idx int, start double, end double, text string")
    p = spark.createDataFrame([(1, i, k, float(a), t) for i, (*_, ph) in enumerate(words) for k, (t, a) in enumerate(ph)], "utt int, word_idx int, ph_idx int, start double, text string")
    lyrics = spark.createDataFrame([(1, chars)], "utt int, chars array<string>")
    got = pipeline.vowel_spans(w, p, lyrics, language).orderBy("word_idx", "part").collect()
    return [(round(r["dur"], 6), r["voiced"], r["lyric"]) for r in got]


def test_vowel_spans(spark):
    """The first two are fixed test vectors."""
    ja = [("ka", 0, 0.25, [("k", 0), ("a", 0.08)]), ("ni", 0.25, 0.5, [("n", 0.25), ("i", 0.33)])]
    assert spans(spark, ja, ["か", "に"], "ja") == [(0.08, 0, ""), (0.25, 1, "か"), (0.17, 1, "に")]
    zh = [("ang", 0, 0.3, [("a", 0), ("ng", 0.22)]), ("ni", 0.3, 0.6, [("n", 0.3), ("i", 0.36)])]
    assert spans(spark, zh, ["昂", "你"], "zh") == [(0.36, 1, "昂"), (0.24, 1, "你")]
    rests = [("SP", 0, 0.5, [("SP", 0)]), ("la", 0.5, 1.0, [("l", 0.5), ("a", 0.503)]), ("AP", 1.0, 1.2, []), ("s", 1.2, 1.4, [("s", 1.2)]), ("lo", 1.4, 2.0, [("l", 1.4), ("o", 1.5)])]
    assert spans(spark, rests, ["Oh", "LA", "x", "Lo"], "zh") == [(0.5, 0, ""), (0.497, 1, "LA"), (0.2, 0, ""), (0.2, 0, ""), (0.1, 0, ""), (0.5, 1, "Lo")]
    assert [x[2] for x in spans(spark, rests, ["lo", "la"], "zh") if x[1]] == ["la", "lo"]  # behind the first match no other is left
    assert [x[2] for x in spans(spark, rests, ["唱"], "zh") if x[1]] == ["唱", "lo"]


def test_cuts_of_each_kind_of_run():
    """Silent runs that are short, medium and long against the rule read run by run; also at either end."""
    r = np.random.default_rng(6)
    for _ in range(60):
        c = slicing.Silence(threshold=-20.0, min_length=int(r.integers(100, 900)), min_interval=int(r.integers(40, 300)), hop=20, max_kept=int(r.integers(40, 400)))
        parts = []
        for k in range(int(r.integers(1, 9))):
            parts.append((0.02 if (k + int(r.integers(0, 2))) % 2 else 1.0) * r.normal(size=int(r.integers(10, 900))))
        x = np.concatenate(parts).astype(np.float32)
        got, total, hop = c.cuts(x, 1000)
        least, apart, near = round(c.min_length / 20), round(c.min_interval / 20), round(c.max_kept / 20)
        if -(-len(x) // 20) <= least:
            assert got == []
            continue
        level = slicing.rms(x, min(c.min_interval, 80), 20)
        place = lambda a, b: min(range(a, min(b, total - 1) + 1), key=lambda i: (level[i], i))
        want, clip, i = [], 0, 0
        while i < total:
            j = i
            while j < total and level[j] < 0.1:
                j += 1
            n = j - i
            if n and j == total:
                want += [(place(i, i + near), total + 1)] if n >= apart else []
            elif n and (i == 0 and n > near or n >= apart and j - clip >= least):
                cover = [place(i, j)] if n <= near else [place(i, i + near), place(j - near, j)] + ([place(j - near, i + near)] if n <= 2 * near else [])
                last = cover[0] if n <= near else cover[1] if i == 0 else max(cover)
                want.append((0 if i == 0 else min(cover), last))
                clip = last
            i = max(j, i + 1)
        assert got == want


def test_marks_are_complete(spark):
    text_ = "lǜ zhōng nǐ hǎo ḿ ǹg lüè ā á ǎ à ō ó ǒ ò ē é ě è ī í ǐ ì ū ú ǔ ù ǖ ǘ ǚ ǜ"
    got = spark.createDataFrame([(text_,)], "t string").select(text.without_tone(F.col("t")).alias("p")).first()["p"]
    assert got == "lv zhong ni hao m ng lve a a a a o o o o e e e e i i i i u u u u v v v v"


def test_note_merging():
    p = lambda onset, dur, pitch, slur=0, lyric="la", voiced=1: {"onset": onset, "dur": dur, "pitch": pitch, "slur": slur, "lyric": lyric, "voiced": voiced}
    got = pipeline.merged_notes([p(0, 1, None), p(1, 1, 60.0, 1), p(2, 1, 60.05, 1), p(3, 1, 62.0, 1), p(4, 1, 62.0, 0, "li")])
    assert [(n["onset"], n["offset"], n["lyric"]) for n in got] == [(1, 3, "la"), (3, 4, "-"), (4, 5, "li")]
