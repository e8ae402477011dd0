"""Queries on frames, series, decoders and codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import codecs
from strandline.operators import decoding, series, slicing
from strandline.plans import pipeline
from strandline.plans.registry import query
from strandline.runtime import ship, table
from strandline.schema import NOTES_SQL, WORDS_SQL
from strandline.schema import notes as notes_of
from strandline.schema import words as words_of

_EMB = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)\n"


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(
    _EMB
    + """, p AS (SELECT vec_id, list_concat([0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0], v, [0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0]) AS p FROM e),
f AS (SELECT vec_id, i, list_slice(p, i * 8 + 1, i * 8 + 16) AS w FROM p, range(9) t(i))
SELECT vec_id, i AS frame_idx, round(sqrt(list_sum(list_transform(w, lambda x: x * x)) / 16), 9) AS rms, round(20 * log10(greatest(sqrt(list_sum(list_transform(w, lambda x: x * x)) / 16), 1e-10)), 6) AS db FROM f"""
)
def frame_rms(spark, sf_dir):
    d = _emb(spark, sf_dir).select("vec_id", series.frame_rms(F.col("v"), 16, 8).alias("r")).select("vec_id", F.arrays_zip(F.col("r"), series.decibels(F.col("r")).alias("d")).alias("z"))
    d = d.select("vec_id", F.posexplode("z").alias("frame_idx", "z"))
    return d.select("vec_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.round(F.col("z.r"), 9).alias("rms"), F.round(F.col("z.d"), 6).alias("db"))


@query(
    _EMB
    + """, x AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM e)
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best, CAST(list_position(v, list_min(v)) - 1 AS INT) AS worst, round(list_max(ex) / list_sum(ex), 9) AS p_best FROM x"""
)
def softmax_argmax(spark, sf_dir):
    v = F.col("v")
    return _emb(spark, sf_dir).select("vec_id", series.argmax(v).alias("best"), series.argmin(v).alias("worst"), F.round(F.array_max(series.softmax(v)), 9).alias("p_best"))


@query(
    _EMB
    + """, s AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS s FROM e), a AS (SELECT *, list_position(s, list_max(s)) - 1 AS pk FROM s),
b AS (SELECT *, greatest(0, pk - 4) AS lo, least(63, pk + 4) AS hi FROM a),
c AS (SELECT vec_id, s, lo, hi, list_max(s) AS mx, list_sum(list_transform(range(lo, hi + 1), lambda i: s[i + 1] * (i * 7180.0::DOUBLE / 63 + 1997.3794084376191::DOUBLE))) AS top, list_sum(list_slice(s, lo + 1, hi + 1)) AS tot FROM b),
h AS (SELECT vec_id, CASE WHEN mx > 0.03 THEN top / greatest(tot, 1e-8) ELSE 0.0 END AS cents FROM c)
SELECT vec_id, round(cents, 5) AS cents, round(10 * pow(2.0, cents / 1200), 5) AS hz, round(69 + 12 * log2(10 * pow(2.0, cents / 1200) / 440), 6) AS midi FROM h"""
)
def salience_f0(spark, sf_dir):
    d = _emb(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.abs(x)).alias("s"))
    d = d.select("vec_id", series.local_mean_cents(F.col("s")).alias("cents"))
    hz = series.cents_to_hz(F.col("cents"))
    return d.select("vec_id", F.round("cents", 5).alias("cents"), F.round(hz, 5).alias("hz"), F.round(series.hz_to_midi(hz), 6).alias("midi"))


_PITCH = NOTES_SQL + ", pr AS (SELECT track_id, note_idx, CASE WHEN lyric IN ('', '-') THEN NULL ELSE pitch END AS v FROM notes)\n"


def _pitch(spark, sf_dir):
    return notes_of(spark, sf_dir).select("track_id", "note_idx", F.when(~F.col("lyric").isin("", "-"), F.col("pitch")).alias("v"))


@query(
    _PITCH
    + """, a AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN note_idx END IGNORE NULLS) OVER b AS pi,
  first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN note_idx END IGNORE NULLS) OVER f AS ni FROM pr
  WINDOW b AS (PARTITION BY track_id ORDER BY note_idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY track_id ORDER BY note_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, note_idx, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((note_idx - pi) / CAST(ni - pi AS DOUBLE)) END, 9) AS filled FROM a"""
)
def f0_fill(spark, sf_dir):
    return series.fill_linear(_pitch(spark, sf_dir), ["track_id"], "note_idx", "v").select("track_id", "note_idx", F.round("filled", 9).alias("filled"))


@query(
    NOTES_SQL
    + """, w AS (SELECT track_id, note_idx, list_sort(list(pitch) OVER (PARTITION BY track_id ORDER BY note_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS w FROM notes)
SELECT track_id, note_idx, w[len(w) // 2 + 1] AS smooth FROM w"""
)
def median_filter(spark, sf_dir):
    return series.median_filter(notes_of(spark, sf_dir), ["track_id"], "note_idx", "pitch").select("track_id", "note_idx", "smooth")


_XY = NOTES_SQL + ", xy AS (SELECT track_id, CAST(floor(onset * 10) AS BIGINT) * 5 AS x, max(CAST(floor(pitch) AS BIGINT)) AS y FROM notes GROUP BY ALL)\n"


@query(
    _XY
    + """, d AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM xy WINDOW w AS (PARTITION BY track_id ORDER BY x)),
g AS (SELECT track_id, x + i * 5 AS x, y + (ny - y) * (i * 5 / CAST(nx - x AS DOUBLE)) AS y FROM (SELECT *, unnest(range(1, CAST((nx - x) // 5 AS BIGINT))) AS i FROM d WHERE (nx - x) // 5 - 1 BETWEEN 1 AND 12))
SELECT track_id, x, round(CAST(y AS DOUBLE), 6) AS y FROM xy UNION ALL SELECT track_id, x, round(y, 6) FROM g"""
)
def fill_short_gaps(spark, sf_dir):
    n = notes_of(spark, sf_dir)
    xy = n.groupBy("track_id", (F.floor(F.col("onset") * 10).cast("bigint") * 5).alias("x")).agg(F.max(F.floor("pitch").cast("bigint")).alias("y"))
    return series.fill_short_gaps(xy, ["track_id"]).select("track_id", F.col("x").cast("bigint").alias("x"), F.round("y", 6).alias("y"))


@query(
    NOTES_SQL
    + """, c AS (SELECT *, lag(lyric) OVER (PARTITION BY track_id ORDER BY note_idx) AS p FROM notes)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY note_idx) - 1 AS pos, note_idx AS frame, lyric AS token FROM c WHERE (p IS NULL OR p <> lyric) AND lyric <> '-'"""
)
def ctc_collapse(spark, sf_dir):
    return series.ctc_collapse(notes_of(spark, sf_dir), ["track_id"], "note_idx", "lyric", "-")


@query(
    NOTES_SQL
    + """, h AS (SELECT track_id, note_idx, CASE WHEN note_idx - lag(note_idx) OVER (PARTITION BY track_id ORDER BY note_idx) - 1 > 1 THEN 1 ELSE 0 END AS nw FROM notes WHERE pitch >= 60),
g AS (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY note_idx ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT track_id, min(note_idx) AS first, max(note_idx) AS last FROM g GROUP BY track_id, g HAVING max(note_idx) - min(note_idx) + 1 >= 4"""
)
def hysteresis_runs(spark, sf_dir):
    return series.hysteresis_runs(notes_of(spark, sf_dir), ["track_id"], "note_idx", "pitch", 60.0, 1, 4)


@query(
    NOTES_SQL
    + """, g AS (SELECT track_id, note_idx, note_idx - row_number() OVER (PARTITION BY track_id ORDER BY note_idx) AS g FROM notes WHERE pitch >= 60),
r AS (SELECT track_id, min(note_idx) AS first, max(note_idx) AS last, count(*) AS n FROM g GROUP BY track_id, g)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, first) = 1"""
)
def longest_run(spark, sf_dir):
    return series.longest_run(notes_of(spark, sf_dir), ["track_id"], "note_idx", F.col("pitch") >= 60)


@query(
    NOTES_SQL
    + """, k AS (SELECT track_id, note_idx, len(list_distinct(list(lyric) OVER (PARTITION BY track_id ORDER BY note_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))) AS k, row_number() OVER (PARTITION BY track_id ORDER BY note_idx) AS n FROM notes)
SELECT track_id, min(note_idx) AS stopped_at FROM k WHERE n > 15 AND k <= 3 GROUP BY track_id"""
)
def repetition_guard(spark, sf_dir):
    return series.repeats_itself(notes_of(spark, sf_dir), ["track_id"], "note_idx", "lyric")


def _durations(spark, sf_dir):
    n = notes_of(spark, sf_dir).select("track_id", "note_idx", (F.col("offset") - F.col("onset")).alias("d"))
    return n.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("note_idx", "d")))["d"].alias("d"))


@query(
    NOTES_SQL
    + """, d AS (SELECT track_id, note_idx, "offset" - onset AS d, count(CASE WHEN "offset" - onset >= 0.35::DOUBLE THEN 1 END) OVER (PARTITION BY track_id ORDER BY note_idx ROWS UNBOUNDED PRECEDING) AS c FROM notes),
h AS (SELECT track_id, coalesce(sum(d) FILTER (c = 0), 0) AS head FROM d GROUP BY track_id),
g AS (SELECT d.*, CASE WHEN c = 0 THEN 0 WHEN head < 0.35::DOUBLE THEN c - 1 ELSE c END AS g FROM d JOIN h USING (track_id))
SELECT track_id, CAST(count(DISTINCT g) AS INT) AS n, round(sum(d) FILTER (g = 0), 9) AS first_dur, round(sum(d), 6) AS total FROM g GROUP BY track_id"""
)
def merge_tiny(spark, sf_dir):
    d = _durations(spark, sf_dir).select("track_id", slicing.merge_tiny(F.col("d")).alias("m"))
    return d.select("track_id", F.size("m").alias("n"), F.round(F.get("m", F.lit(0)), 9).alias("first_dur"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    NOTES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, p AS (SELECT track_id, note_idx AS i, pitch * 100 AS x, lead(pitch * 100) OVER (PARTITION BY track_id ORDER BY note_idx) AS nx FROM notes),
s AS (SELECT track_id, i, x AS v FROM p WHERE i = 0
  UNION ALL SELECT p.track_id, p.i, CASE WHEN nx IS NOT NULL AND abs(x - (v + nx) / 2) > 75 THEN x * (1 - 0.7::DOUBLE) + (v + nx) / 2 * 0.7::DOUBLE ELSE x END FROM s JOIN p ON p.track_id = s.track_id AND p.i = s.i + 1)
SELECT track_id, CAST(i AS INT) AS note_idx, round(v, 6) AS smooth FROM s"""
)
def adaptive_smooth(spark, sf_dir):
    n = notes_of(spark, sf_dir)
    d = n.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("note_idx", (F.col("pitch") * 100).alias("p"))))["p"].alias("p"))
    return d.select("track_id", F.posexplode(series.adaptive_smooth(F.col("p"))).alias("note_idx", "smooth")).withColumn("smooth", F.round("smooth", 6))


@query()
def merge_short(spark, sf_dir):
    """Chunks of the notes' own lengths at 100 samples a second, joined up to the bounds."""
    ship(spark)

    def run(batches):
        for b in batches:
            out = []
            for t, on, d in zip(b["track_id"], b["on"], b["d"], strict=True):
                chunks = [(float(o), np.zeros(round(x * 100), np.float32)) for o, x in zip(on, d, strict=True)]
                out += [(t, k, o, len(x)) for k, (o, x) in enumerate(slicing.merge_short(chunks, 100, 3.0, 8.0))]
            yield pd.DataFrame(out, columns=["track_id", "chunk_idx", "offset", "n_samples"])

    n = notes_of(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("note_idx", "onset", (F.col("offset") - F.col("onset")).alias("d")))).alias("r"))
    return n.select("track_id", F.col("r.onset").alias("on"), F.col("r.d").alias("d")).mapInPandas(run, "track_id bigint, chunk_idx int, offset double, n_samples int")


def _waves(spark, sf_dir):
    """A synthetic wave for each track: a tone where notes sound, silence between, 1000 samples a second, up to the last offset."""
    n = notes_of(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("onset", "offset"))).alias("r"))

    def run(batches):
        for b in batches:
            for t, r in zip(b["track_id"], b["r"], strict=True):
                ends = [(int(iv["onset"] * 1000), int(iv["offset"] * 1000)) for iv in r]
                x = np.zeros(max(z for _, z in ends), np.float32)
                for a, z in ends:
                    x[a:z] = np.sin(np.arange(z - a) * 0.3)
                yield pd.DataFrame({"source_id": [t], "sr": [1000], "samples": [x]})

    return n.mapInPandas(run, "source_id bigint, sr int, samples array<float>")


@query(
    WORDS_SQL
    + """, n AS (SELECT track_id AS utt, word_idx, "end" AS e, text, CASE WHEN text NOT IN ('', 'purchase') THEN start + ("end" - start) * 0.25::DOUBLE END AS nuc FROM words),
u AS (SELECT *, CASE WHEN nuc IS NOT NULL THEN coalesce(lead(nuc) OVER w, e) ELSE e END AS til, count(nuc) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS k FROM n WINDOW w AS (PARTITION BY utt ORDER BY word_idx)),
r AS (SELECT *, greatest(0.0::DOUBLE, coalesce(max(til) OVER (PARTITION BY utt ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS reached FROM u),
s AS (SELECT utt, word_idx, 0 AS part, CASE WHEN nuc IS NULL THEN e - reached WHEN nuc > reached + 0.005::DOUBLE THEN nuc - reached END AS dur, 0 AS voiced, '' AS lyric FROM r
  UNION ALL SELECT utt, word_idx, 1, greatest(0.0::DOUBLE, til - greatest(nuc, reached)), 1, CASE WHEN k < 40 THEN 'é' || k ELSE text END FROM r WHERE nuc IS NOT NULL)
SELECT utt, word_idx, part, round(dur, 9) AS dur, voiced, lyric FROM s WHERE voiced = 1 OR dur > 0"""
)
def vowel_spans(spark, sf_dir):
    """Words of a consonant and, but for ``purchase``, a vowel that begins at a quarter; forty lyrics for each track."""
    w = words_of(spark, sf_dir).withColumnRenamed("track_id", "utt")
    vowel = F.struct(F.lit(1).alias("ph_idx"), (F.col("start") + (F.col("end") - F.col("start")) * 0.25).alias("start"), F.when(F.col("text") == "purchase", "n").otherwise("a").alias("text"))
    phones = w.select("utt", "word_idx", F.explode(F.array(F.struct(F.lit(0).alias("ph_idx"), "start", F.lit("k").alias("text")), vowel)).alias("p")).select("utt", "word_idx", "p.*")
    lyrics = w.select("utt").distinct().withColumn("chars", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("é"), i.cast("string"))))
    return pipeline.vowel_spans(w, phones, lyrics, "zh").withColumn("dur", F.round("dur", 9))


@query()
def silence_slicer(spark, sf_dir):
    ship(spark)
    return slicing.slice_rows(_waves(spark, sf_dir), "default").drop("samples")


@query()
def smart_slicer(spark, sf_dir):
    ship(spark)
    return slicing.slice_rows(_waves(spark, sf_dir), "smart", 4.0, 10.0).drop("samples")


@query()
def viterbi_align(spark, sf_dir):
    """Eight embeddings in turn, fewer at the end, make the logits of one utterance: 64 phones by frames, three of them expected."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("utt"), "vec_id", "embedding")
    g = e.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))["embedding"].alias("frames"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.transform("frames", lambda f: F.get(f, p) * 8))
    edges = F.transform("frames", lambda f: F.get(f, F.lit(5)) * 6)
    return decoding.decode_utterances(g.select("utt", logits.alias("logits"), edges.alias("edges"), F.array(*[F.lit(i) for i in (0, 7, 11, 0)]).alias("phones")))


@query()
def codec_roundtrip(spark, sf_dir):
    """Bytes and largest error of each codec with blocks of 32 on the embeddings."""
    ship(spark)
    kinds = [k for k in codecs.ENCODE if codecs.SIZES[k][0] <= 32]

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                x = np.asarray(v, np.float32)
                for k in kinds:
                    raw = codecs.quantize(x, k)
                    out.append((i, k, len(raw), float(np.abs(codecs.dequantize(raw, k) - x).max())))
            yield pd.DataFrame(out, columns=["vec_id", "codec", "bytes", "error"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, codec string, bytes int, error double")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), b AS (SELECT vec_id, i, list_slice(v, i * 32 + 1, i * 32 + 32) AS w FROM e, range(2) t(i)),
d AS (SELECT vec_id, i, w, list_max(list_transform(w, lambda x: abs(x))) / 127 AS d FROM b)
SELECT vec_id, i AS block, CAST(list_sum(list_transform(w, lambda x: CASE WHEN d = 0 THEN 0 ELSE round(x / d) END)) AS BIGINT) AS q_sum FROM d"""
)
def q8_blocks(spark, sf_dir):
    """The eight-bit codec's block sums in array functions."""
    d = _emb(spark, sf_dir).select("vec_id", F.posexplode(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("block", "w"))
    d = d.withColumn("d", F.array_max(F.transform("w", lambda x: F.abs(x))) / 127)
    q = F.transform("w", lambda x: F.when(F.col("d") == 0, 0.0).otherwise(F.round(x / F.col("d"))))
    return d.select("vec_id", F.col("block").cast("bigint").alias("block"), F.aggregate(q, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("q_sum"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) > 0 AS voiced FROM embeddings")
def model_hook(spark, sf_dir):
    """A stand-in model behind the batch inference hook: the sign of each vector's sum."""

    def model(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": b["vec_id"], "voiced": [float(np.sum(v, dtype=float)) > 0 for v in b["embedding"]]})

    return decoding.infer(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), model, "vec_id bigint, voiced boolean")


@query("SELECT event_id, value, CAST(CASE WHEN n % 100 > 0 THEN ((((n % 100 - 1) // 2 + 1) - 1) // 2 + 1 - 1) // 2 + 1 ELSE 0 END + n // 100 * 13 AS BIGINT) AS frames, CAST(ceil(n / 100.0) * 100 AS BIGINT) AS padded FROM (SELECT event_id, value, CAST(floor(value * 10) AS BIGINT) AS n FROM events)")
def feature_lengths(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.floor(F.col("value") * 10).cast("bigint").alias("n"))
    return e.select("event_id", "value", series.feature_length(F.col("n")).alias("frames"), series.pad_block(F.col("n")).alias("padded"))
