"""Writers: each makes rows of (path, content) in the plan; ``write_files`` puts them in any store.

One file for each track or source, made by the task that holds its rows."""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.notes import midi_note, note_name, valid_notes
from strandline.runtime import ship


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``files`` (path, content) under ``root`` (any URI that Arrow's file systems know): path, n_bytes.

    A file is written under another name and moved, so a task that runs again leaves whole files."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                to = posixpath.join(base, p)
                store.create_dir(posixpath.dirname(to), recursive=True)
                tmp = f"{to}.{uuid.uuid4().hex}"
                with store.open_output_stream(tmp) as f:
                    f.write(c)
                store.move(tmp, to)
            yield pd.DataFrame({"path": b["path"], "n_bytes": [len(c) for c in b["content"]]})

    content = F.col("content").cast("binary")
    return files.select("path", content.alias("content")).mapInPandas(run, "path string, n_bytes bigint")


# notes -----------------------------------------------------------------------


def midi_events(notes: list[tuple[float, float, float, str]], tempo: float) -> list[tuple[int, bytes]]:
    """(delta ticks, event) by onset: no note starts before the last end, each lasts a tick at least."""
    out, last = [], 0
    for onset, offset, pitch, lyric in sorted(notes, key=lambda n: n[0]):
        on = max(round(onset * tempo * 8), last)
        off = max(round(offset * tempo * 8), on + 1)
        key, wait = min(127, max(0, round(pitch))), on - last
        if lyric:
            text = lyric.encode()
            out.append((wait, b"\xff\x05" + _varlen(len(text)) + text))
            wait = 0
        out += [(wait, bytes((0x90, key, 100))), (off - on, bytes((0x80, key, 64)))]
        last = off
    return out


def _varlen(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def midi_bytes(notes: list[tuple[float, float, float, str]], tempo: float = 120.0) -> bytes:
    """A standard MIDI file with one track at 480 ticks to a beat."""
    events = [(0, b"\xff\x51\x03" + round(60_000_000 / tempo).to_bytes(3, "big")), *midi_events(notes, tempo), (0, b"\xff\x2f\x00")]
    track = b"".join(_varlen(d) + e for d, e in events)
    return b"MThd" + struct.pack(">IHHH", 6, 1, 1, 480) + b"MTrk" + struct.pack(">I", len(track)) + track


def midi_files(notes: DataFrame, tempo: float = 120.0) -> DataFrame:
    ship(notes.sparkSession)

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["onset", "note_idx"], kind="stable")
        raw = midi_bytes(list(pdf[["onset", "offset", "pitch", "lyric"]].itertuples(index=False, name=None)), tempo)
        return pd.DataFrame({"path": [f"{pdf['track_id'].iloc[0]}.mid"], "content": [raw]})

    return valid_notes(notes).groupBy("track_id").applyInPandas(track, "path string, content binary")


def _three(c: Column) -> Column:
    """Three decimals, half to even."""
    return F.format_string("%.3f", F.rint(c * 1000) / 1000)


def note_text_files(notes: DataFrame, kind: str = "csv", pitch: str = "name", rounded: bool = True) -> DataFrame:
    """Onset, offset, pitch and, if a track has any, lyric: CSV with a header, or tabs without. Rows keep their order."""
    sep = "," if kind == "csv" else "\t"
    p = note_name(F.col("pitch"), not rounded) if pitch == "name" else (midi_note(F.col("pitch")).cast("string") if rounded else _three(F.col("pitch")))
    rows = valid_notes(notes).select("track_id", "note_idx", "lyric", F.concat_ws(sep, _three(F.col("onset")), _three(F.col("offset")), p).alias("line"))
    g = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("note_idx", "line", "lyric"))).alias("r"), F.max(F.col("lyric") != "").alias("some"))
    lines = F.transform("r", lambda x: F.when(F.col("some"), F.concat_ws(sep, x["line"], x["lyric"])).otherwise(x["line"]))
    head = F.when(F.col("some"), f"onset{sep}offset{sep}pitch{sep}lyric\n").otherwise(f"onset{sep}offset{sep}pitch\n") if kind == "csv" else F.lit("")
    return g.select(F.concat(F.col("track_id").cast("string"), F.lit(f".{kind}")).alias("path"), F.concat(head, F.array_join(lines, "\n"), F.lit("\n")).cast("binary").alias("content"))


def project_notes(notes: DataFrame, tempo: float = 120.0) -> DataFrame:
    """position, duration (10 ticks at least), tone and lyric (``a`` if none) of each note."""
    from strandline.schema import ticks

    pos = ticks(F.col("onset"), tempo)
    return valid_notes(notes).select("track_id", "note_idx", pos.alias("position"), F.greatest(F.lit(10), ticks(F.col("offset"), tempo) - pos).alias("duration"), midi_note(F.col("pitch")).alias("tone"), F.when(F.col("lyric") == "", "a").otherwise(F.col("lyric")).alias("lyric"))


def project_files(notes: DataFrame, tempo: float = 120.0, curves: DataFrame | None = None) -> DataFrame:
    """A singing-synthesis project for each track, as JSON, which YAML readers read. ``curves``: track_id, x, y of the pitch deviation."""
    n = project_notes(notes, tempo)
    part = n.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("position", "note_idx", "duration", "tone", "lyric"))).alias("notes"), F.greatest(F.lit(480), F.max(F.col("position") + F.col("duration"))).alias("duration"))
    if curves is not None:
        c = curves.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("c"))
        part = part.join(c, "track_id", "left")
    curve = F.when(F.col("c").isNotNull(), F.array(F.struct(F.lit("pitd").alias("abbr"), F.col("c.x").alias("xs"), F.col("c.y").alias("ys")))) if curves is not None else F.lit(None)
    notes_ = F.transform("notes", lambda x: F.struct(x["position"].alias("position"), x["duration"].alias("duration"), x["tone"].alias("tone"), x["lyric"].alias("lyric")))
    name = F.col("track_id").cast("string")
    doc = F.struct(
        name.alias("name"), F.lit("0.6").alias("ustx_version"), F.lit(480).alias("resolution"), F.lit(float(tempo)).alias("bpm"), F.lit(4).alias("beat_per_bar"), F.lit(4).alias("beat_unit"),
        F.array(F.struct(F.lit(0).alias("position"), F.lit(float(tempo)).alias("bpm"))).alias("tempos"), F.array(F.struct(F.lit(0).alias("bar_position"), F.lit(4).alias("beat_per_bar"), F.lit(4).alias("beat_unit"))).alias("time_signatures"),
        F.array(F.struct(F.lit("Track1").alias("track_name"))).alias("tracks"), F.array(F.struct(F.col("duration"), name.alias("name"), F.lit(0).alias("track_no"), F.lit(0).alias("position"), notes_.alias("notes"), curve.alias("curves"))).alias("voice_parts"),
    )
    return part.select(F.concat(name, F.lit(".ustx")).alias("path"), F.to_json(doc).cast("binary").alias("content"))


# labels ----------------------------------------------------------------------


def textgrid(length: float, tiers: list[tuple[str, list[tuple[float, float, str]]]]) -> str:
    """The long text form; gaps become empty intervals."""
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {length:g}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for k, (name, rows) in enumerate(tiers, 1):
        full, at = [], 0.0
        for a, b, mark in rows:
            if a > at:
                full.append((at, a, ""))
            full.append((a, b, mark))
            at = b
        if at < length:
            full.append((at, length, ""))
        out += [f"    item [{k}]:", '        class = "IntervalTier"', f'        name = "{name}"', "        xmin = 0", f"        xmax = {length:g}", f"        intervals: size = {len(full)}"]
        for i, (a, b, mark) in enumerate(full, 1):
            out += [f"        intervals [{i}]:", f"            xmin = {a:.17g}", f"            xmax = {b:.17g}", '            text = "{}"'.format(mark.replace('"', '""'))]
    return "\n".join(out) + "\n"


def textgrid_files(words: DataFrame, phones: DataFrame, lengths: DataFrame) -> DataFrame:
    """``words`` and ``phones`` (utt, start, end, text), ``lengths`` (utt, length)."""
    ship(words.sparkSession)
    tier = lambda d, n: d.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct(F.greatest(F.col("start"), F.lit(0.0)).alias("start"), "end", "text"))).alias(n))
    d = lengths.join(tier(words, "w"), "utt", "left").join(tier(phones, "p"), "utt", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda r: [(x["start"], x["end"], x["text"]) for x in r] if r is not None else []
        for b in batches:
            yield pd.DataFrame({"path": [f"{u}.TextGrid" for u in b["utt"]], "content": [textgrid(n, [("words", rows(w)), ("phones", rows(p))]).encode() for n, w, p in zip(b["length"], b["w"], b["p"], strict=True)]})

    return d.mapInPandas(run, "path string, content binary")


def htk_files(rows: DataFrame, folder: str) -> DataFrame:
    """Lines of start and end in 100 ns and text, a file for each utterance with its own rows only."""
    ns = lambda c: F.floor(F.col(c) * 10_000_000).cast("bigint").cast("string")
    g = rows.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("start", F.concat_ws(" ", ns("start"), ns("end"), "text").alias("line")))).alias("r"))
    return g.select(F.concat(F.lit(f"HTK/{folder}/"), F.col("utt").cast("string"), F.lit(".lab")).alias("path"), F.concat(F.array_join("r.line", "\n"), F.lit("\n")).cast("binary").alias("content"))


def lab_files(chunks: DataFrame) -> DataFrame:
    """``chunks`` (name, text): one text file each."""
    return chunks.select(F.concat("name", F.lit(".lab")).alias("path"), F.trim(F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


def wav_files(chunks: DataFrame) -> DataFrame:
    """``chunks`` (name, sr, samples)."""
    from strandline.sources.audio import encode_wav

    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            yield pd.DataFrame({"path": b["name"] + ".wav", "content": [encode_wav(np.asarray(x, np.float32), int(sr)) for x, sr in zip(b["samples"], b["sr"], strict=True)]})

    return chunks.select("name", "sr", "samples").mapInPandas(run, "path string, content binary")


def timestamp_files(chunks: DataFrame) -> DataFrame:
    """``chunks`` (stem, source_path, source_md5, index, offset, duration, text): JSON for each source, by offset, times to a microsecond."""
    six = lambda c: F.round(F.col(c), 6)
    rec = F.struct(six("offset").alias("offset"), F.col("index"), six("duration").alias("duration"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    g = chunks.groupBy("stem", "source_path", "source_md5").agg(F.array_sort(F.collect_list(rec)).alias("r"))
    doc = F.struct(F.struct(F.col("source_path").alias("path"), F.col("source_md5").alias("md5")).alias("source"), F.transform("r", lambda x: F.struct(x["index"].alias("index"), x["offset"].alias("offset"), x["duration"].alias("duration"), x["text"].alias("text"))).alias("chunks"))
    return g.select(F.concat("stem", F.lit(".json")).alias("path"), F.to_json(doc).cast("binary").alias("content"))


def match_log(rows: DataFrame) -> DataFrame:
    """``rows`` (source, chunk_idx, status, recognized, matched): a text block for each chunk, a file for each source."""
    block = F.concat_ws("\n", F.format_string("[chunk %d] %s", "chunk_idx", "status"), F.concat(F.lit("  heard:   "), "recognized"), F.concat(F.lit("  matched: "), F.coalesce("matched", F.lit(""))))
    g = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", block.alias("block")))).alias("r"))
    return g.select(F.concat(F.col("source").cast("string"), F.lit("_match.txt")).alias("path"), F.concat(F.array_join("r.block", "\n\n"), F.lit("\n")).cast("binary").alias("content"))


def lyric_json_files(matched: DataFrame) -> DataFrame:
    """``matched`` (stem, raw_text, lab): raw_text, lab, lab_without_tone."""
    doc = F.struct("raw_text", "lab", F.col("lab").alias("lab_without_tone"))
    return matched.select(F.concat("stem", F.lit(".json")).alias("path"), F.to_json(doc).cast("binary").alias("content"))


def index_json(state: list[dict]) -> str:
    """The state table as one JSON map by content, for readers of the older index file."""
    return json.dumps({r["md5"]: {k: v for k, v in r.items() if k != "md5"} for r in state}, ensure_ascii=False, indent=2)
