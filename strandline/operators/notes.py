"""Validation, pitch names, gaps, segments and the closed-form grid quantizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.schema import by_track, ticks

NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def is_valid(onset: Column, offset: Column, pitch: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(onset) & finite(offset) & finite(pitch) & (offset > onset)


def valid_notes(notes: DataFrame) -> DataFrame:
    """Finite onset, offset and pitch, and offset after onset."""
    return notes.where(is_valid(F.col("onset"), F.col("offset"), F.col("pitch")))


def reject_counts(notes: DataFrame) -> DataFrame:
    ok = is_valid(F.col("onset"), F.col("offset"), F.col("pitch"))
    return notes.groupBy("track_id").agg(F.count("*").alias("n"), F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("rejected"))


def midi_note(pitch: Column) -> Column:
    """Half-even rounding, then 0..127."""
    return F.least(F.lit(127), F.greatest(F.lit(0), F.rint(pitch))).cast("int")


def note_name(pitch: Column, cents: bool = False) -> Column:
    """C4 is 60; with ``cents``, a signed whole number of cents follows when it is not 0."""
    near = F.rint(pitch).cast("int")
    name = F.concat(F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.pmod(near, F.lit(12)) + 1), (F.floor(near / 12) - 1).cast("string"))
    off = F.rint((pitch - near) * 100).cast("int")
    return F.concat(name, F.when((off != 0), F.format_string("%+d", off)).otherwise("")) if cents else name


def name_pitch(name: Column) -> Column:
    """The pitch of a note name with optional cents: the round trip quantizes to a cent."""
    step = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.regexp_extract(name, r"^([A-G]#?)", 1)) - 1
    octave = F.regexp_extract(name, r"^[A-G]#?(-?\d+)", 1).cast("int")
    cents = F.coalesce(F.nullif(F.regexp_extract(name, r"^[A-G]#?-?\d+([+-]\d+)$", 1), F.lit("")).cast("double"), F.lit(0.0))
    return (octave + 1) * 12 + step + cents / 100


def with_gap(pairs: DataFrame) -> DataFrame:
    """raw_gap: max(0, start - previous end), 0 for the first of a track."""
    prev = F.lag("raw_end").over(by_track("raw_start", "note_idx"))
    return pairs.withColumn("raw_gap", F.coalesce(F.greatest(F.lit(0), F.col("raw_start") - prev), F.lit(0)).cast("bigint"))


def with_segments(pairs: DataFrame, step: int = 120, longest: int = 48, least_gap: int = 240) -> DataFrame:
    """segment: a new one at gaps of max(3 step, 240) ticks, then after every 48 notes.

    Within a gap group the hard split is a division of the row number, so two windows suffice."""
    w = by_track("raw_start", "note_idx")
    cut = (F.row_number().over(w) > 1) & (F.col("raw_gap") >= max(3 * step, least_gap))
    d = pairs.withColumn("_g", F.sum(cut.cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = F.floor((F.row_number().over(W.partitionBy("track_id", "_g").orderBy("raw_start", "note_idx")) - 1) / longest)
    d = d.withColumn("_p", part)
    fresh = F.coalesce(F.lag(F.struct("_g", "_p")).over(w) != F.struct("_g", "_p"), F.lit(False))
    return d.withColumn("segment", F.sum(fresh.cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_g", "_p")


def quantize_simple(notes: DataFrame, step: int = 120, tempo: float = 120.0) -> DataFrame:
    """Onset to the nearest grid line, strictly increasing by at least a step; the offset
    follows the next onset where notes touch, lasts a step at least, and stops at the next onset.

    The onset rule is a running maximum: max(r_i - i step) + i step."""
    w = by_track("onset", "note_idx")
    i = F.row_number().over(w) - 1
    grid = lambda c: (F.rint(ticks(F.col(c), tempo) / F.lit(float(step))) * step).cast("bigint")
    d = notes.withColumns({"_i": i, "_on": grid("onset"), "_off": grid("offset"), "_next": F.lead("onset").over(w)})
    d = d.withColumn("on_tick", (F.max(F.col("_on") - F.col("_i") * step).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_i") * step).cast("bigint"))
    d = d.withColumn("_lead", F.lead("on_tick").over(w))
    touch = F.col("_next").isNotNull() & (F.abs(F.col("_next") - F.col("offset")) < 0.001)
    off = F.greatest(F.when(touch, F.col("_lead")).otherwise(F.col("_off")), F.col("on_tick") + step)
    return d.withColumn("off_tick", F.least(off, F.coalesce("_lead", off)).cast("bigint")).drop("_i", "_on", "_off", "_next", "_lead")


def repair_overlaps_on_grid(pairs: DataFrame, step: int = 120) -> DataFrame:
    """q_start, q_end made free of overlap when all ticks lie on the grid and every note lasts
    at least a step: start at the running maximum of ends, at least a step long.

    Off-grid ticks need the fold in ``strandline.operators.quantize``."""
    w = by_track("q_start", "note_idx")
    d = pairs.withColumns({"_i": F.row_number().over(w), "_a": F.greatest("q_start", F.coalesce(F.lag("q_end").over(w), F.col("q_start")))})
    start = F.max(F.col("_a") - F.col("_i") * step).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_i") * step
    d = d.withColumn("fixed_start", start.cast("bigint"))
    return d.withColumn("fixed_end", F.greatest(F.col("q_end"), F.col("fixed_start") + step).cast("bigint")).drop("_i", "_a")


def track_summary(quantized: DataFrame) -> DataFrame:
    return quantized.groupBy("track_id").agg(F.count("*").alias("n_notes"), F.min("on_tick").alias("first_tick"), F.max("off_tick").alias("last_tick"), F.sum(F.col("off_tick") - F.col("on_tick")).alias("sounding_ticks"))
