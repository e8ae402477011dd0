"""Streams of frames and notes: sessions on silence gaps and an online slicer.

Additions of this engine: the batch operators have streaming forms where a recording
arrives piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of ``events`` of a key with no pause longer than ``gap``; rows later than ``late`` are dropped. In a batch the watermark says nothing."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


STATE = "begin long, last_loud long"
OUT = "key string, start long, end long"


def online_slices(frames: DataFrame, threshold: float, quiet: int, time: str = "at", late: str = "10 seconds", idle: int = 60_000):
    """``frames`` (key, frame, level and a time) to chunks [start, end): a chunk ends after ``quiet`` frames under the
    threshold, or when the watermark is ``idle`` milliseconds past the last frame of its key.

    State for a key is two numbers, so it is bounded whatever the length of the recording. Frames of a key come in
    order but for those of one batch; those behind the watermark are dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begin, last = state.get if state.exists else (-1, -1)
        out = []
        if state.hasTimedOut:
            state.remove()
            if begin >= 0:
                out.append((key[0], begin, last + 1))
        else:
            rows = pd.concat(list(batches)).sort_values("frame")
            for f in rows.loc[rows["level"] >= threshold, "frame"].tolist():
                if begin >= 0 and f - last > quiet:
                    out.append((key[0], begin, last + 1))
                    begin = -1
                begin, last = (f if begin < 0 else begin), f
            state.update((begin, last))
            newest = int(rows["at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle)
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end"])

    d = frames.withWatermark(time, late).select("key", "frame", "level", F.col(time).alias("at"))
    return d.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
