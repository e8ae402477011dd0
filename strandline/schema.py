"""The relations that operators work on, and how the driver's tables stand in for them.

``notes``: track_id, note_idx, onset, offset (seconds), pitch (float MIDI), lyric.
``""`` is no lyric and ``"-"`` continues the previous one. All times are DOUBLE
seconds or BIGINT ticks at 480 to a beat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.runtime import table

TICKS_PER_BEAT = 480
TIE = "-"


def ticks(seconds: Column, tempo: float = 120.0) -> Column:
    """Half-even rounding, multiplied left to right."""
    return F.rint(seconds * F.lit(float(tempo)) * F.lit(8.0)).cast("bigint")


def seconds(tick: Column, tempo: float = 120.0) -> Column:
    return tick / (F.lit(float(tempo)) * F.lit(8.0))


def grid_round(x: Column, step: int) -> Column:
    """Nearest multiple of ``step``, half to even."""
    return (F.rint(x / F.lit(float(step))) * step).cast("bigint")


def by_track(*order: str):
    return W.partitionBy("track_id").orderBy(*(order or ("onset", "note_idx")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track for each user of ``events``, time compressed 60 000 times."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    w = W.partitionBy("user_id")
    lyric = F.when(F.col("event_type") == "error", "-").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    d = e.select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(w.orderBy(us, "event_id")) - 1).cast("bigint").alias("note_idx"),
        F.floor((us - F.min(us).over(w)) / F.lit(60000.0)).cast("bigint").alias("on_us"),
        (50000 + k * 6000).cast("bigint").alias("dur_us"),
        (F.lit(48.0) + (F.rint(F.col("value") * 100).cast("bigint") % 3600) / F.lit(100.0)).alias("pitch"),
        lyric.alias("lyric"),
    )
    return d.select("track_id", "note_idx", (F.col("on_us") / F.lit(1e6)).alias("onset"), ((F.col("on_us") + F.col("dur_us")) / F.lit(1e6)).alias("offset"), "pitch", "lyric")


#: The same relation in DuckDB: start a query with it.
NOTES_SQL = """WITH ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, event_type,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
nt AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS BIGINT) AS note_idx,
    CAST(floor((us - min(us) OVER (PARTITION BY user_id)) / 60000.0) AS BIGINT) AS on_us, CAST(50000 + k * 6000 AS BIGINT) AS dur_us,
    48.0::DOUBLE + (CAST(round_even(value * 100, 0) AS BIGINT) % 3600) / 100.0::DOUBLE AS pitch,
    CASE event_type WHEN 'error' THEN '-' WHEN 'view' THEN '' ELSE event_type END AS lyric FROM ev),
notes AS (SELECT track_id, note_idx, on_us / 1000000.0::DOUBLE AS onset, (on_us + dur_us) / 1000000.0::DOUBLE AS "offset", pitch, lyric FROM nt)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth note's onset up to the next such onset: track_id, word_idx, start, end, text."""
    n = notes(spark, sf_dir).where("note_idx % 4 = 0")
    d = n.select("track_id", (F.col("note_idx") / 4).cast("bigint").alias("word_idx"), F.col("onset").alias("start"), F.lead("onset").over(by_track("note_idx")).alias("end"), F.col("lyric").alias("text"))
    return d.where("end > start")


WORDS_SQL = NOTES_SQL + """, words AS (SELECT * FROM (SELECT track_id, note_idx // 4 AS word_idx, onset AS start,
    lead(onset) OVER (PARTITION BY track_id ORDER BY note_idx) AS "end", lyric AS text FROM notes WHERE note_idx % 4 = 0) WHERE "end" > start)
"""


def grid_notes(spark: SparkSession, sf_dir: str, step: int = 120) -> DataFrame:
    """``notes`` with raw_start, raw_end, raw_dur ticks."""
    on = ticks(F.col("onset"))
    end = F.greatest(on + 1, ticks(F.col("offset")))
    return notes(spark, sf_dir).withColumns({"raw_start": on, "raw_end": end, "raw_dur": F.greatest(F.lit(1), end - on)})


TICKS_SQL = NOTES_SQL + """, tk AS (SELECT *, CAST(round_even(onset * 120.0::DOUBLE * 8.0::DOUBLE, 0) AS BIGINT) AS raw_start,
    greatest(CAST(round_even(onset * 120.0::DOUBLE * 8.0::DOUBLE, 0) AS BIGINT) + 1, CAST(round_even("offset" * 120.0::DOUBLE * 8.0::DOUBLE, 0) AS BIGINT)) AS raw_end FROM notes)
"""
