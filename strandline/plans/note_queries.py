"""Queries on notes and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import grid, intervals, notes, quantize, stats
from strandline.plans.registry import query
from strandline.runtime import table
from strandline.schema import NOTES_SQL, TICKS_SQL, WORDS_SQL, by_track, grid_notes, ticks
from strandline.schema import notes as notes_of
from strandline.schema import words as words_of

BAD_SQL = """, mixed AS (SELECT track_id, note_idx, onset, "offset", pitch, lyric FROM notes UNION ALL
  SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.5::DOUBLE, 200.0::DOUBLE, 'hi'), (-1, 1, 0.6, 0.4, 60.0, 'bad'), (-1, 2, 0.7, 1.0, 'NaN'::DOUBLE, 'nan'), (-1, 3, 0.0, 0.5, -12.0, 'low'), (-1, 4, 0.0, NULL, 1.0, 'null')))
"""
VALID = '"offset" > onset AND isfinite(onset) AND isfinite("offset") AND isfinite(pitch)'


def mixed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes, with rows that validation is about."""
    bad = spark.createDataFrame([(-1, 0, 0.0, 0.5, 200.0, "hi"), (-1, 1, 0.6, 0.4, 60.0, "bad"), (-1, 2, 0.7, 1.0, float("nan"), "nan"), (-1, 3, 0.0, 0.5, -12.0, "low"), (-1, 4, 0.0, None, 1.0, "null")], "track_id bigint, note_idx bigint, onset double, offset double, pitch double, lyric string")
    return notes_of(spark, sf_dir).unionByName(bad)


@query(NOTES_SQL + BAD_SQL + f"SELECT * FROM mixed WHERE {VALID}")
def notes_valid(spark, sf_dir):
    return notes.valid_notes(mixed_notes(spark, sf_dir))


@query(NOTES_SQL + BAD_SQL + f"SELECT track_id, count(*) AS n, CAST(sum(CASE WHEN coalesce({VALID}, false) THEN 0 ELSE 1 END) AS BIGINT) AS rejected FROM mixed GROUP BY track_id")
def reject_counts(spark, sf_dir):
    return notes.reject_counts(mixed_notes(spark, sf_dir))


@query(TICKS_SQL + "SELECT track_id, note_idx, raw_start, raw_end, raw_end - raw_start AS raw_dur, raw_start / 960.0::DOUBLE AS back FROM tk")
def notes_ticks(spark, sf_dir):
    return grid_notes(spark, sf_dir).select("track_id", "note_idx", "raw_start", "raw_end", F.col("raw_dur").cast("bigint"), (F.col("raw_start") / 960.0).alias("back"))


@query(NOTES_SQL + BAD_SQL + f"SELECT track_id, note_idx, CAST(least(127, greatest(0, round_even(pitch, 0))) AS INT) AS midi FROM mixed WHERE {VALID}")
def notes_pitch_clamped(spark, sf_dir):
    return notes.valid_notes(mixed_notes(spark, sf_dir)).select("track_id", "note_idx", notes.midi_note(F.col("pitch")).alias("midi"))


@query(
    NOTES_SQL
    + """, r AS (SELECT track_id, note_idx, CAST(round_even(pitch, 0) AS INT) AS m, CAST(round_even((pitch - round_even(pitch, 0)) * 100, 0) AS INT) AS c FROM notes)
SELECT track_id, note_idx, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], m % 12 + 1) || CAST(m // 12 - 1 AS VARCHAR) AS name,
 list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], m % 12 + 1) || CAST(m // 12 - 1 AS VARCHAR) || CASE WHEN c = 0 THEN '' WHEN c > 0 THEN '+' || c ELSE CAST(c AS VARCHAR) END AS name_cents, m + c / 100.0::DOUBLE AS pitch_back FROM r"""
)
def pitch_names(spark, sf_dir):
    d = notes_of(spark, sf_dir).select("track_id", "note_idx", notes.note_name(F.col("pitch")).alias("name"), notes.note_name(F.col("pitch"), True).alias("name_cents"))
    return d.withColumn("pitch_back", notes.name_pitch(F.col("name_cents")))


_SIMPLE = (
    TICKS_SQL
    + """, g AS (SELECT *, row_number() OVER w - 1 AS i, CAST(round_even(round_even(onset * 120.0::DOUBLE * 8.0::DOUBLE, 0) / 120.0, 0) * 120 AS BIGINT) AS r_on,
  CAST(round_even(round_even("offset" * 120.0::DOUBLE * 8.0::DOUBLE, 0) / 120.0, 0) * 120 AS BIGINT) AS r_off, lead(onset) OVER w AS nx FROM tk WINDOW w AS (PARTITION BY track_id ORDER BY onset, note_idx)),
h AS (SELECT *, CAST(max(r_on - i * 120) OVER (PARTITION BY track_id ORDER BY onset, note_idx ROWS UNBOUNDED PRECEDING) + i * 120 AS BIGINT) AS on_tick FROM g),
k AS (SELECT *, lead(on_tick) OVER (PARTITION BY track_id ORDER BY onset, note_idx) AS ld FROM h),
qn AS (SELECT track_id, note_idx, on_tick, CAST(least(greatest(CASE WHEN nx IS NOT NULL AND abs(nx - "offset") < 0.001 THEN ld ELSE r_off END, on_tick + 120), coalesce(ld, 9000000000000)) AS BIGINT) AS off_tick, pitch, lyric FROM k)
"""
)


@query(_SIMPLE + "SELECT * FROM qn")
def quantize_simple(spark, sf_dir):
    return notes.quantize_simple(notes_of(spark, sf_dir)).select("track_id", "note_idx", "on_tick", "off_tick", "pitch", "lyric")


@query(_SIMPLE + "SELECT track_id, count(*) AS n_notes, min(on_tick) AS first_tick, max(off_tick) AS last_tick, CAST(sum(off_tick - on_tick) AS BIGINT) AS sounding_ticks FROM qn GROUP BY track_id")
def track_summary(spark, sf_dir):
    return notes.track_summary(notes.quantize_simple(notes.valid_notes(notes_of(spark, sf_dir))))


_GAP = TICKS_SQL + ", gp AS (SELECT *, CAST(coalesce(greatest(0, raw_start - lag(raw_end) OVER (PARTITION BY track_id ORDER BY raw_start, note_idx)), 0) AS BIGINT) AS raw_gap FROM tk)\n"


@query(_GAP + "SELECT track_id, note_idx, raw_gap FROM gp")
def gap_annotate(spark, sf_dir):
    return notes.with_gap(grid_notes(spark, sf_dir)).select("track_id", "note_idx", "raw_gap")


@query(
    _GAP
    + """, a AS (SELECT *, CAST(sum(CASE WHEN rn > 1 AND raw_gap >= 360 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY raw_start, note_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY raw_start, note_idx) AS rn FROM gp)),
b AS (SELECT *, (row_number() OVER (PARTITION BY track_id, g ORDER BY raw_start, note_idx) - 1) // 48 AS p FROM a)
SELECT track_id, note_idx, dense_rank() OVER (PARTITION BY track_id ORDER BY g, p) - 1 AS segment FROM b"""
)
def phrase_segments(spark, sf_dir):
    return notes.with_segments(notes.with_gap(grid_notes(spark, sf_dir))).select("track_id", "note_idx", "segment")


def _on_grid(spark, sf_dir):
    g = lambda c: (F.rint(F.col(c) / F.lit(120.0)) * 120).cast("bigint")
    return grid_notes(spark, sf_dir).select("track_id", "note_idx", g("raw_start").alias("q_start"), g("raw_end").alias("q_end"))


@query(
    TICKS_SQL
    + """, gr AS (SELECT track_id, note_idx, CAST(round_even(raw_start / 120.0, 0) * 120 AS BIGINT) AS q_start, CAST(round_even(raw_end / 120.0, 0) * 120 AS BIGINT) AS q_end FROM tk),
a AS (SELECT *, row_number() OVER w AS i, greatest(q_start, coalesce(lag(q_end) OVER w, q_start)) AS a FROM gr WINDOW w AS (PARTITION BY track_id ORDER BY q_start, note_idx)),
b AS (SELECT *, CAST(max(a - i * 120) OVER (PARTITION BY track_id ORDER BY q_start, note_idx ROWS UNBOUNDED PRECEDING) + i * 120 AS BIGINT) AS fixed_start FROM a)
SELECT track_id, note_idx, fixed_start, CAST(greatest(q_end, fixed_start + 120) AS BIGINT) AS fixed_end FROM b"""
)
def overlap_repair(spark, sf_dir):
    return notes.repair_overlaps_on_grid(_on_grid(spark, sf_dir)).select("track_id", "note_idx", "fixed_start", "fixed_end")


@query(
    _GAP
    + """, k AS (SELECT *, raw_end - raw_start AS raw_dur, CAST(greatest(1, round_even((raw_end - raw_start) / 120.0, 0)) AS BIGINT) AS k_dur, CAST(round_even(raw_gap / 120.0, 0) AS BIGINT) AS k_gap, lyric = '-' AS k_tie FROM gp),
m AS (SELECT track_id, k_dur, k_gap, k_tie, count(*) AS n, median(raw_dur) AS med_dur, median(raw_gap) AS med_gap FROM k GROUP BY ALL HAVING count(*) >= 6)
SELECT k.track_id, k.note_idx, k.k_dur, k.k_gap, k.k_tie, coalesce(m.n, 1) AS n, CAST(m.med_dur AS DOUBLE) AS med_dur, CAST(m.med_gap AS DOUBLE) AS med_gap, CASE WHEN m.n IS NULL THEN 0.0::DOUBLE ELSE least(0.65::DOUBLE, 0.18::DOUBLE + 0.12::DOUBLE * (m.n - 6)) END AS strength
FROM k LEFT JOIN m USING (track_id, k_dur, k_gap, k_tie)"""
)
def motif_priors(spark, sf_dir):
    d = stats.motif_priors(notes.with_gap(grid_notes(spark, sf_dir)), ["track_id"])
    return d.select("track_id", "note_idx", "k_dur", "k_gap", "k_tie", "n", "med_dur", "med_gap", "strength")


@query(
    TICKS_SQL
    + """, s AS (SELECT track_id, raw_start - CAST(round_even(raw_start / 120.0, 0) AS BIGINT) * 120 AS shift, raw_start % 120 AS phase FROM tk),
m AS (SELECT track_id, CAST(median(shift) AS DOUBLE) AS center, CAST(median(phase) AS DOUBLE) AS phase_med, count(*) AS n FROM s GROUP BY track_id),
d AS (SELECT track_id, center, phase_med, n, avg(abs(shift - center)) AS spread FROM s JOIN m USING (track_id) GROUP BY ALL)
SELECT track_id, center, phase_med, n, round(spread, 9) AS spread, round(greatest(0.0, 1 - least(spread / 48.0::DOUBLE, 1.0)), 9) AS strength FROM d"""
)
def phase_center(spark, sf_dir):
    d = stats.phase_center(grid_notes(spark, sf_dir), ["track_id"])
    return d.select("track_id", "center", "phase_med", "n", F.round("spread", 9).alias("spread"), F.round("strength", 9).alias("strength"))


@query(
    NOTES_SQL
    + """, m AS (SELECT track_id, median(pitch) AS med FROM notes GROUP BY track_id),
d AS (SELECT track_id, pitch, med, abs(pitch - med) AS dev FROM notes JOIN m USING (track_id)),
mad AS (SELECT track_id, median(dev) AS mad FROM d GROUP BY track_id)
SELECT track_id, round(any_value(med), 9) AS med, round(any_value(mad), 9) AS mad, round(coalesce(avg(CASE WHEN mad > 0 AND dev / (1.4826::DOUBLE * mad) <= 1.5 THEN pitch END), any_value(med)), 9) AS robust,
 count(CASE WHEN mad > 0 AND dev / (1.4826::DOUBLE * mad) <= 1.5 THEN 1 END) AS kept FROM d JOIN mad USING (track_id) GROUP BY track_id"""
)
def mad_outlier_mean(spark, sf_dir):
    d = stats.robust_mean(notes_of(spark, sf_dir), ["track_id"], "pitch")
    return d.select("track_id", F.round("med", 9).alias("med"), F.round("mad", 9).alias("mad"), F.round("robust", 9).alias("robust"), "kept")


@query(
    NOTES_SQL
    + """, b AS (SELECT track_id, note_idx // 3 AS bar, list(lyric ORDER BY note_idx) AS seq FROM notes GROUP BY ALL),
g AS (SELECT track_id, seq, count(*) AS n, min(bar) AS first_seen FROM b GROUP BY ALL)
SELECT track_id, array_to_string(seq, ' ') AS seq, n, first_seen FROM g QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, len(seq) DESC, first_seen) = 1"""
)
def majority_group(spark, sf_dir):
    n = notes_of(spark, sf_dir).withColumn("bar", F.floor(F.col("note_idx") / 3))
    bars = n.groupBy("track_id", "bar").agg(F.array_sort(F.collect_list(F.struct("note_idx", "lyric")))["lyric"].alias("seq"))
    return stats.majority(bars, ["track_id"], "seq", "bar").select("track_id", F.array_join("seq", " ").alias("seq"), "n", "first_seen")


@query(
    TICKS_SQL
    + """, k(k) AS (SELECT unnest(range(-3, 4))),
c AS (SELECT track_id, note_idx, raw_start, raw_end, CAST((round_even(raw_start / 120.0, 0) + a.k) * 120 AS BIGINT) AS s, CAST((round_even(raw_end / 120.0, 0) + b.k) * 120 AS BIGINT) AS e FROM tk, k a, k b),
o AS (SELECT *, abs(s - raw_start) <= 120 AND abs(e - raw_end) <= 120 AS ok, abs(s - raw_start) + abs(e - raw_end) AS sh, abs((e - s) - (raw_end - raw_start)) AS du FROM c WHERE e > s),
r AS (SELECT *, bool_or(ok) OVER w AS anyok, row_number() OVER (PARTITION BY track_id, note_idx ORDER BY sh, du, s, e) AS rn FROM o WINDOW w AS (PARTITION BY track_id, note_idx))
SELECT track_id, note_idx, s, e FROM r WHERE ok OR (NOT anyok AND rn = 1)"""
)
def grid_candidates(spark, sf_dir):
    d = grid_notes(spark, sf_dir)
    p = grid.within_shift(grid.candidate_pairs(F.col("raw_start"), F.col("raw_end"), 120), F.col("raw_start"), F.col("raw_end"), 120)
    return d.select("track_id", "note_idx", F.explode(p).alias("p")).select("track_id", "note_idx", F.col("p.s").cast("bigint").alias("s"), F.col("p.e").cast("bigint").alias("e"))


@query(
    TICKS_SQL
    + """, x AS (SELECT track_id, note_idx, raw_start, raw_end - raw_start AS d FROM tk)
SELECT track_id, note_idx, CASE WHEN raw_start % 480 = 0 THEN 0.0 WHEN raw_start % 240 = 0 THEN 0.04 * 120 WHEN raw_start % 120 = 0 THEN 0.1 * 120 ELSE 0.42 * 120 END::DOUBLE AS metrical,
 (CASE WHEN greatest(1, round_even(d / 120.0, 0)) IN (1,2,4,8,16,32) THEN 0.0 WHEN greatest(1, round_even(d / 120.0, 0)) IN (3,6,12,24) THEN 0.05 * 120 ELSE 0.16 * 120 END)::DOUBLE AS note_value,
 CAST(CASE WHEN d <= 45 THEN NULL WHEN d / 120.0 <= 1.5 THEN 120 WHEN d / 120.0 <= 2.625 THEN 240 WHEN d / 120.0 <= 3.375 THEN 360 WHEN d / 120.0 <= 4.625 THEN 480 WHEN d / 120.0 <= 5.625 THEN 600 WHEN d / 120.0 <= 7.0 THEN 720 ELSE greatest(120, round_even(d / 120.0, 0) * 120) END  AS BIGINT) AS preferred,
 CAST(least(raw_start % 120, 120 - raw_start % 120) AS BIGINT) AS off_grid FROM x"""
)
def metrical_penalty(spark, sf_dir):
    d, s, n = grid_notes(spark, sf_dir), F.col("raw_start"), F.col("raw_dur")
    return d.select("track_id", "note_idx", grid.metrical_penalty(s, 120).alias("metrical"), grid.note_value_penalty(n, 120).alias("note_value"), grid.preferred_duration(n, 120).alias("preferred"), grid.grid_distance(s, 120).cast("bigint").alias("off_grid"))


@query(
    TICKS_SQL
    + """, c AS (SELECT track_id, note_idx, raw_end - raw_start AS d, m * 120 AS v, row_number() OVER (PARTITION BY track_id, note_idx ORDER BY m) AS i FROM tk, (VALUES (1),(2),(3),(4),(6),(8),(12),(16),(24),(32)) t(m) WHERE m * 120 <= raw_end - raw_start + 240)
SELECT track_id, note_idx, CAST(v AS BIGINT) AS nearest FROM c QUALIFY row_number() OVER (PARTITION BY track_id, note_idx ORDER BY abs(v - d), i) = 1"""
)
def nearest_candidate(spark, sf_dir):
    d = grid_notes(spark, sf_dir)
    return d.select("track_id", "note_idx", grid.nearest(grid.duration_candidates(F.col("raw_dur"), 120), F.col("raw_dur")).cast("bigint").alias("nearest"))


@query(
    NOTES_SQL
    + """, d AS (SELECT "offset" - onset AS dur FROM notes),
g AS (SELECT a.v AS lo, b.v AS hi, a.i * 3 + b.i AS o FROM (VALUES (0, 0.1::DOUBLE), (1, 0.2), (2, 0.3)) a(i, v), (VALUES (0, 0.4::DOUBLE), (1, 0.5), (2, 0.6)) b(i, v)),
s AS (SELECT lo, hi, o, sum(CASE WHEN dur < lo THEN 1 ELSE 0 END) * 1.5 + sum(CASE WHEN dur > hi THEN 1 ELSE 0 END) + 0.5 * abs(count(*) - sum(dur) / ((lo + hi) / 2)) AS score FROM d, g GROUP BY lo, hi, o)
SELECT lo, hi, round(CAST(score AS DOUBLE), 4) AS score FROM s ORDER BY score, o LIMIT 1"""
)
def param_grid_best(spark, sf_dir):
    d = notes_of(spark, sf_dir).select((F.col("offset") - F.col("onset")).alias("dur"))
    return stats.best_parameters(d, [0.1, 0.2, 0.3], [0.4, 0.5, 0.6]).select("lo", "hi", F.round("score", 4).alias("score"))


_WORD_VOICED = WORDS_SQL + ", wv AS (SELECT *, text <> '' AS voiced FROM words)\n"


@query(
    _WORD_VOICED
    + """, p AS (SELECT w.track_id, w.word_idx, greatest(w.start, n.onset) AS s, least(w."end", n."offset") AS e, CAST(least(127, greatest(0, round_even(n.pitch, 0))) AS INT) AS name
  FROM wv w JOIN notes n ON w.track_id = n.track_id AND n.onset < w."end" AND n."offset" > w.start WHERE w.voiced),
q AS (SELECT *, CASE WHEN lag(name) OVER v = name THEN 0 ELSE 1 END AS nw FROM p WHERE e - s > 0.0001 WINDOW v AS (PARTITION BY track_id, word_idx ORDER BY s, e, name)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY track_id, word_idx ORDER BY s, e, name ROWS UNBOUNDED PRECEDING) AS run FROM q),
u AS (SELECT track_id, word_idx, run, min(s) AS p_start, sum(e - s) AS dur, CAST(any_value(name) AS VARCHAR) AS name FROM r GROUP BY ALL)
SELECT track_id, word_idx, p_start, round(dur, 9) AS dur, name, CASE WHEN run = 1 THEN 0 ELSE 1 END AS slur FROM u
UNION ALL SELECT track_id, word_idx, start, round("end" - start, 9), 'rest', 0 FROM wv WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.track_id = wv.track_id AND u.word_idx = wv.word_idx)"""
)
def interval_overlap_join(spark, sf_dir):
    w = words_of(spark, sf_dir).withColumn("voiced", F.col("text") != "")
    n = notes_of(spark, sf_dir).select("track_id", F.col("onset").alias("n_start"), F.col("offset").alias("n_end"), notes.midi_note(F.col("pitch")).cast("string").alias("name"))
    # names order as numbers in the SQL; equal starts and ends decide nothing else
    d = intervals.word_notes(w.select("track_id", "word_idx", "start", "end", "voiced"), n.withColumn("name", F.lpad("name", 3, "0")), ["track_id"])
    return d.select("track_id", "word_idx", "p_start", F.round("dur", 9).alias("dur"), F.when(F.col("name") == "rest", "rest").otherwise(F.col("name").cast("int").cast("string")).alias("name"), "slur")


@query(
    WORDS_SQL
    + """, m AS (SELECT DISTINCT track_id, onset + 0.004 AS mark FROM notes WHERE note_idx % 2 = 0 UNION SELECT DISTINCT track_id, "offset" FROM notes),
b AS (SELECT w.track_id, w.word_idx, w.start AS t, min(struct_pack(d := abs(m.mark - w.start), mark := m.mark)) AS b FROM words w JOIN m ON w.track_id = m.track_id AND abs(m.mark - w.start) <= 0.01 GROUP BY ALL)
SELECT w.track_id, w.word_idx AS point_idx, w.start AS t, coalesce(b.b.mark, w.start) AS snapped FROM words w LEFT JOIN b ON w.track_id = b.track_id AND w.word_idx = b.word_idx"""
)
def boundary_snap(spark, sf_dir):
    n = notes_of(spark, sf_dir)
    marks = n.where("note_idx % 2 = 0").select("track_id", (F.col("onset") + 0.004).alias("mark")).unionByName(n.select("track_id", F.col("offset").alias("mark"))).distinct()
    points = words_of(spark, sf_dir).select("track_id", F.col("word_idx").alias("point_idx"), F.col("start").alias("t"))
    return intervals.snap(points, marks, ["track_id"]).select("track_id", "point_idx", "t", "snapped")


@query()
def boundary_align(spark, sf_dir):
    """The fold after snapping: inner boundaries in order."""
    return intervals.ordered_boundaries(boundary_snap(spark, sf_dir), ["track_id"]).select("track_id", "point_idx", "t", F.round("aligned", 9).alias("aligned"))


@query(
    NOTES_SQL
    + """, p AS (SELECT track_id, note_idx AS p_idx, onset + 0.1 AS t FROM notes)
SELECT p.track_id, p.p_idx, p.t, min(struct_pack(s := n.onset, i := n.note_idx)).i AS note_idx FROM p JOIN notes n ON p.track_id = n.track_id AND n.onset <= p.t AND p.t < n."offset" GROUP BY ALL"""
)
def point_in_interval(spark, sf_dir):
    n = notes_of(spark, sf_dir)
    points = n.select("track_id", F.col("note_idx").alias("p_idx"), (F.col("onset") + 0.1).alias("t"))
    iv = n.select("track_id", F.col("onset").alias("start"), F.col("offset").alias("end"), "note_idx")
    return intervals.points_in(points, iv, ["track_id"], 1.0, "note_idx").select("track_id", "p_idx", "t", "note_idx")


@query(
    NOTES_SQL
    + """, f AS (SELECT track_id, note_idx AS frame_idx, pitch AS value FROM notes), l AS (SELECT track_id, max(frame_idx) AS mx FROM f GROUP BY track_id)
SELECT n.track_id, n.note_idx, f.frame_idx, f.value FROM notes n JOIN l USING (track_id) JOIN f ON f.track_id = n.track_id AND f.frame_idx = greatest(0, least(l.mx, CAST(round_even(n.onset / 0.5::DOUBLE, 0) AS BIGINT)))"""
)
def asof_frame(spark, sf_dir):
    n = notes_of(spark, sf_dir)
    series = n.select("track_id", F.col("note_idx").alias("frame_idx"), F.col("pitch").alias("value"))
    return intervals.nearest_frame(n.select("track_id", "note_idx", F.col("onset").alias("t")), series, ["track_id"], 0.5).select("track_id", "note_idx", "frame_idx", "value")


@query(
    WORDS_SQL
    + """, e0 AS (SELECT track_id, onset AS s, "offset" AS e FROM notes WHERE note_idx % 3 = 0),
e1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM e0),
e2 AS (SELECT track_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM e1) GROUP BY track_id, g),
h AS (SELECT w.track_id, w.word_idx, w.start, w."end", e2.s, e2.e FROM words w LEFT JOIN e2 ON w.track_id = e2.track_id AND e2.s < w."end" AND e2.e > w.start),
p AS (SELECT track_id, word_idx, coalesce(lag(e) OVER (PARTITION BY track_id, word_idx ORDER BY s), start) AS p_start, coalesce(s, "end") AS p_end FROM h
  UNION ALL SELECT track_id, word_idx, max(e), any_value("end") FROM h WHERE e IS NOT NULL GROUP BY track_id, word_idx)
SELECT track_id, word_idx AS new_idx, p_start, p_end FROM p WHERE p_end - p_start >= 0.1"""
)
def interval_subtract(spark, sf_dir):
    new = words_of(spark, sf_dir).select("track_id", F.col("word_idx").alias("new_idx"), "start", "end")
    old = notes_of(spark, sf_dir).where("note_idx % 3 = 0").select("track_id", F.col("onset").alias("start"), F.col("offset").alias("end"))
    return intervals.subtract(new, old, ["track_id"], 4.0).select("track_id", "new_idx", "p_start", "p_end")


# intervals that leave gaps: every other word
_SPARSE = WORDS_SQL + """, sp AS (SELECT track_id, word_idx, start, start + ("end" - start) * 0.9 AS "end", text FROM words WHERE word_idx % 5 <> 2),
ln AS (SELECT track_id, max("end") + 0.05 AS length FROM words GROUP BY track_id)
"""


def _sparse(spark, sf_dir):
    w = words_of(spark, sf_dir)
    length = w.groupBy("track_id").agg((F.max("end") + 0.05).alias("length"))
    return w.where("word_idx % 5 <> 2").withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 0.9), length


@query(
    _SPARSE
    + """SELECT track_id, word_idx, CASE WHEN lag("end") OVER w IS NULL AND start > 0 AND start <= 0.1 THEN 0.0 ELSE start END AS f_start,
 CASE WHEN lead(start) OVER w IS NULL AND length - "end" <= 0.1 THEN greatest("end", length) WHEN lead(start) OVER w > "end" AND lead(start) OVER w - "end" <= 0.1 THEN lead(start) OVER w ELSE "end" END AS f_end
FROM sp JOIN ln USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY start)"""
)
def fill_gaps(spark, sf_dir):
    w, length = _sparse(spark, sf_dir)
    return intervals.fill_small_gaps(w, length, ["track_id"]).select("track_id", "word_idx", "f_start", "f_end")


@query(
    _SPARSE
    + """, g AS (SELECT track_id, coalesce(lag("end") OVER (PARTITION BY track_id ORDER BY start), 0.0) AS s, start AS e FROM sp
  UNION ALL SELECT ln.track_id, coalesce(m.s, 0.0), length FROM ln LEFT JOIN (SELECT track_id, max("end") AS s FROM sp GROUP BY track_id) m USING (track_id))
SELECT track_id, start, "end", text FROM sp UNION ALL SELECT track_id, s, e, 'SP' FROM g WHERE e > s"""
)
def tile_silence(spark, sf_dir):
    w, length = _sparse(spark, sf_dir)
    return intervals.tile(w, length, ["track_id"])


@query(
    _WORD_VOICED
    + """, f AS (SELECT track_id, word_idx, "end" - start AS dur, voiced, CASE WHEN NOT voiced AND NOT lag(voiced) OVER w THEN 0 ELSE 1 END AS nw FROM wv WINDOW w AS (PARTITION BY track_id ORDER BY word_idx)),
r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY track_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT track_id, run, round(sum(dur), 9) AS dur, CAST(CASE WHEN any_value(voiced) THEN 0 ELSE 1 END AS INT) AS flag, count(*) AS n FROM r GROUP BY track_id, run"""
)
def merge_unvoiced(spark, sf_dir):
    w = words_of(spark, sf_dir).select("track_id", "word_idx", (F.col("end") - F.col("start")).alias("dur"), "text")
    return intervals.merge_runs(w, ["track_id"], "word_idx", F.col("text") == "").withColumn("dur", F.round("dur", 9))


@query(
    WORDS_SQL
    + """, l AS (SELECT *, greatest(0.0, "end" - start) AS dur FROM words WHERE text NOT IN ('SP','AP','EP','br','sil','pau','')),
d AS (SELECT *, lag(dur) OVER w AS pd, lead(dur) OVER w AS nd, lead(start) OVER w AS ns, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY dur, start) AS rk FROM l WINDOW w AS (PARTITION BY track_id ORDER BY start))
SELECT track_id, word_idx, dur, pd AS prev_dur, nd AS next_dur, ns AS next_start FROM d WHERE n >= 3 AND rk <= greatest(3, floor(n * 0.15::DOUBLE + 0.999999::DOUBLE)) AND least(pd, nd) > 0 AND dur < least(pd, nd) * 0.6::DOUBLE AND ns > "end" AND pd IS NOT NULL AND nd IS NOT NULL"""
)
def short_word_candidates(spark, sf_dir):
    d = intervals.short_words(words_of(spark, sf_dir), ["track_id"]).where("prev_dur is not null and next_dur is not null")
    return d.select("track_id", "word_idx", "dur", "prev_dur", "next_dur", "next_start")


@query(
    WORDS_SQL
    + """, a AS (SELECT track_id, start AS t0, "end" AS t1, text AS mark FROM words), b AS (SELECT track_id, start + 0.05 AS t0, "end" + 0.05 AS t1, text AS mark FROM words WHERE word_idx % 7 <> 3),
i AS (SELECT a.mark, sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)) AS x FROM a JOIN b ON a.track_id = b.track_id AND a.mark = b.mark AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY a.mark),
t AS (SELECT mark, sum(t1 - t0) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY mark)
SELECT mark, coalesce(round(coalesce(x, 0.0) / nullif(total - coalesce(x, 0.0), 0.0), 6), 0.0) AS iou FROM t LEFT JOIN i USING (mark)"""
)
def iou_by_mark(spark, sf_dir):
    w = words_of(spark, sf_dir).select("track_id", "word_idx", "start", "end", F.col("text").alias("mark"))
    moved = w.where("word_idx % 7 <> 3").select("track_id", (F.col("start") + 0.05).alias("start"), (F.col("end") + 0.05).alias("end"), "mark")
    return stats.iou_by_mark(w.drop("word_idx"), moved, ["track_id"])


@query(_SIMPLE + "SELECT track_id, round(sum(abs(on_tick / 960.0::DOUBLE - onset)), 6) AS distance, round(max(onset) - min(onset), 6) AS span, round(sum(abs(on_tick / 960.0::DOUBLE - onset)) / nullif(max(onset) - min(onset), 0.0), 6) AS ratio FROM k GROUP BY track_id")
def boundary_distance(spark, sf_dir):
    q = notes.quantize_simple(notes_of(spark, sf_dir))
    d = stats.boundary_distance(q.select("track_id", "note_idx", (F.col("on_tick") / 960.0).alias("t")), q.select("track_id", "note_idx", F.col("onset").alias("t")), ["track_id"], "note_idx")
    return d.select("track_id", F.round("distance", 6).alias("distance"), F.round("span", 6).alias("span"), F.round("ratio", 6).alias("ratio"))


# joins of chunks, stems and state -------------------------------------------------


@query(
    NOTES_SQL
    + """, ok AS (SELECT DISTINCT track_id FROM notes WHERE lyric = 'purchase' AND note_idx < 4)
SELECT track_id, note_idx, lyric, 'aligned' AS path FROM notes WHERE track_id IN (SELECT track_id FROM ok) UNION ALL SELECT track_id, note_idx, '' AS lyric, 'fallback' FROM notes WHERE track_id NOT IN (SELECT track_id FROM ok)"""
)
def fallback_anti_join(spark, sf_dir):
    n = notes_of(spark, sf_dir).select("track_id", "note_idx", "lyric")
    ok = n.where("lyric = 'purchase' and note_idx < 4").select("track_id").distinct()
    rest = n.join(ok, "track_id", "left_anti").select("track_id", "note_idx", F.lit("").alias("lyric"), F.lit("fallback").alias("path"))
    return n.join(ok, "track_id", "left_semi").withColumn("path", F.lit("aligned")).unionByName(rest)


@query("SELECT d.doc_id, d.source, CAST(coalesce(l.quality, -1) AS INT) AS quality, CAST(coalesce(l.toxic, -1) AS INT) AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def stem_join(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    return d.join(lab, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def missing_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


@query(NOTES_SQL + "SELECT DISTINCT lyric AS token FROM notes WHERE lyric NOT IN ('-', '', 'click', 'purchase')")
def unknown_tokens(spark, sf_dir):
    known = spark.createDataFrame([("-",), ("",), ("click",), ("purchase",)], "lyric string")
    return notes_of(spark, sf_dir).join(F.broadcast(known), "lyric", "left_anti").select(F.col("lyric").alias("token")).distinct()


@query(
    """WITH f AS (SELECT doc_id, source, md5(text) AS md5 FROM documents), st AS (SELECT DISTINCT md5 FROM f WHERE doc_id % 3 = 0)
SELECT doc_id, source || '_' || substr(md5, 1, 8) AS output_key FROM f WHERE md5 NOT IN (SELECT md5 FROM st)"""
)
def incremental_skip(spark, sf_dir):
    """Sources that the state table does not know by content."""
    f = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("md5"))
    state = f.where("doc_id % 3 = 0").select("md5").distinct()
    return f.join(state, "md5", "left_anti").select("doc_id", F.concat("source", F.lit("_"), F.substring("md5", 1, 8)).alias("output_key"))


@query(
    WORDS_SQL + "SELECT track_id, count(*) AS n, round(min(\"end\" - start), 9) AS min_dur, round(max(\"end\" - start), 9) AS max_dur, round(avg(\"end\" - start), 6) AS avg_dur FROM words GROUP BY track_id"
)
def chunk_stats(spark, sf_dir):
    d = stats.chunk_stats(words_of(spark, sf_dir).withColumn("dur", F.col("end") - F.col("start")), ["track_id"], "dur")
    return d.select("track_id", "n", F.round("min_dur", 9).alias("min_dur"), F.round("max_dur", 9).alias("max_dur"), F.round("avg_dur", 6).alias("avg_dur"))


@query(NOTES_SQL + "SELECT track_id, round(exp(avg(ln(pitch / 100 + 0.000001)) / 3), 9) AS confidence FROM notes GROUP BY track_id")
def total_confidence(spark, sf_dir):
    d = stats.total_confidence(notes_of(spark, sf_dir).withColumn("c", F.col("pitch") / 100), ["track_id"], "c")
    return d.select("track_id", F.round("confidence", 9).alias("confidence"))


# decoders ------------------------------------------------------------------------


@query()
def quantize_smart(spark, sf_dir):
    return quantize.quantize(notes_of(spark, sf_dir), "smart")


@query()
def quantize_dp(spark, sf_dir):
    return quantize.quantize(notes_of(spark, sf_dir), "dp")


@query()
def quantize_bayes(spark, sf_dir):
    return quantize.quantize(notes_of(spark, sf_dir), "bayes")


@query(
    _SPARSE
    + """, r AS (SELECT track_id, start, "end", lag("end") OVER (PARTITION BY track_id ORDER BY start, "end") AS pe FROM sp)
SELECT track_id, min(start) AS place, min(CASE WHEN start >= "end" THEN 'empty' ELSE 'not contiguous' END) AS problem FROM r WHERE start >= "end" OR pe <> start GROUP BY track_id"""
)
def tiling_check(spark, sf_dir):
    return intervals.check_tiling(_sparse(spark, sf_dir)[0], ["track_id"]).select("track_id", F.col("at").alias("place"), "problem")


del W, by_track, ticks
