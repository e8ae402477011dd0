from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import codecs
from strandline.plans import pipeline
from strandline.sources import audio, files, sinks, tensors
from strandline.streaming import silence

NOTE = "track_id bigint, note_idx bigint, onset double, offset double, pitch double, lyric string"


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([(1, 0, 0.0, 0.5, 60.0, "hi"), (1, 1, 0.4, 0.9, 200.0, ""), (1, 2, 0.6, 0.4, 60.0, "bad"), (2, 0, 0.0625, 0.5, 61.26, "")], NOTE)


def test_midi(spark, notes, tmp_path):
    done = sinks.write_files(sinks.midi_files(notes), str(tmp_path)).collect()
    assert sorted(r["path"] for r in done) == ["1.mid", "2.mid"]
    raw = (tmp_path / "1.mid").read_bytes()
    assert raw[:4] == b"MThd" and raw[22:23] == b"\x00" and b"\xff\x05\x02hi" in raw and bytes((0x90, 127, 100)) in raw
    assert sinks.midi_events([(0.4, 0.9, 60, ""), (0.0, 0.5, 62, "")], 120)[2][0] == 0  # overlap: no wait
    assert sinks._varlen(200) == b"\x81\x48"


def test_note_texts(notes):
    rows = {r["path"]: bytes(r["content"]).decode() for r in sinks.note_text_files(notes).collect()}
    assert rows["1.csv"] == "onset,offset,pitch,lyric\n0.000,0.500,C4,hi\n0.400,0.900,G#15,\n"
    assert rows["2.csv"] == "onset,offset,pitch\n0.062,0.500,C#4\n"
    txt = {r["path"]: bytes(r["content"]).decode() for r in sinks.note_text_files(notes, "txt", "number").collect()}
    assert txt["2.txt"] == "0.062\t0.500\t61\n"


def test_projects(notes):
    docs = {r["path"]: json.loads(bytes(r["content"])) for r in sinks.project_files(notes).collect()}
    part = docs["1.ustx"]["voice_parts"][0]
    assert [n["lyric"] for n in part["notes"]] == ["hi", "a"] and part["notes"][1]["tone"] == 127 and part["duration"] == 864
    assert docs["2.ustx"]["voice_parts"][0]["duration"] == 480


def test_labels_out(spark):
    w = spark.createDataFrame([("u", 0.0, 0.5, "a"), ("u", 0.6, 1.0, 'b"')], "utt string, start double, end double, text string")
    n = spark.createDataFrame([("u", 1.2)], "utt string, length double")
    grid = bytes(sinks.textgrid_files(w, w, n).first()["content"]).decode()
    assert grid.count("intervals: size = 4") == 2 and '"b"""' in grid
    two = w.unionByName(spark.createDataFrame([("v", 0.0, 0.1, "z")], w.schema))
    htk = {r["path"]: bytes(r["content"]).decode() for r in sinks.htk_files(two, "Words").collect()}
    assert htk["HTK/Words/v.lab"] == "0 1000000 z\n" and htk["HTK/Words/u.lab"].startswith("0 5000000 a\n")


def test_manifest_and_state(spark, tmp_path):
    c = spark.createDataFrame([("s", "/p/s.wav", "m", 1, 2.0000004, 1.5, " hi "), ("s", "/p/s.wav", "m", 0, 0.0, 2.0, None)], "stem string, source_path string, source_md5 string, index int, offset double, duration double, text string")
    sinks.write_files(sinks.timestamp_files(c), str(tmp_path)).collect()
    got = files.chunk_manifest(spark, str(tmp_path / "s.json")).orderBy("index").collect()
    assert [(r["index"], r["offset"], r["text"], r["source_md5"]) for r in got] == [(0, 0.0, "", "m"), (1, 2.0, "hi", "m")]
    (tmp_path / "bare.json").write_text('[{"index": 3, "offset": 1.0, "duration": 2.0, "text": "x"}]')
    assert files.chunk_manifest(spark, str(tmp_path / "bare.json")).first()["index"] == 3
    s = spark.createDataFrame([(list(range(100)),)], "x array<int>")
    assert len(s.select(files.slices(F.col("x"), F.lit(0.5), F.lit(9.0), 100).alias("y")).first()["y"]) == 50
    done = files.state(spark, str(tmp_path / "none"))
    assert done.count() == 0
    new = spark.createDataFrame([("m", "k", "n", "p", 1, 1)], files.STATE)
    src = spark.createDataFrame([("m", 1), ("q", 2)], "md5 string, v int")
    assert [r["v"] for r in files.todo(src, new).collect()] == [2]
    assert files.upserted(new, new.withColumn("chunks", F.lit(9))).first()["chunks"] == 9


def test_labels_in(spark, tmp_path):
    for name in ("a_1", "a_2", "b_1"):
        (tmp_path / f"{name}.wav").write_bytes(audio.encode_wav(np.zeros(10), 8000))
    (tmp_path / "a_1.lab").write_text("ka ki\n")
    (tmp_path / "a.txt").write_text("lyric of a")
    (tmp_path / "broken.WAV").write_bytes(b"no audio")
    with_label, without = files.labelled_audio(spark, str(tmp_path))
    assert [r["stem"] for r in with_label.collect()] == ["a_1"] and sorted(r["stem"] for r in without.collect()) == ["a_2", "b_1", "broken"]
    labels = spark.createDataFrame([("a_1",), ("b_1",)], "stem string")
    joined, missing = files.labels_with_lyrics(labels, files.lyrics(spark, str(tmp_path)))
    assert {r["stem"]: r["lyric"] for r in joined.collect()} == {"a_1": "lyric of a", "b_1": None} and [r["source"] for r in missing.collect()] == ["b"]
    got = {r["path"].rpartition("/")[2]: r for r in audio.load(files.audio_files(spark, str(tmp_path)), 8000).collect()}
    assert len(got["a_1.wav"]["samples"]) == 10 and got["broken.WAV"]["samples"] is None and got["broken.WAV"]["error"]


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("ka\tk a\nni\tn i\n")
    (tmp_path / "kv.txt").write_text("x:1,2\ny:3\n")
    words = spark.createDataFrame([("u", 0, "ka"), ("u", 1, "zz"), ("u", 2, "ni")], "utt string, word_idx int, word string")
    got = files.phones_of(words, files.dictionary(spark, str(tmp_path / "d.txt"))).orderBy("ph_idx").collect()
    assert [r["ph"] for r in got] == ["SP", "k", "a", "SP", "n", "i", "SP"] and [r["word_idx"] for r in got] == [-1, 0, 0, -1, 2, 2, -1]
    assert {r["key"]: r["value"] for r in files.key_values(spark, str(tmp_path / "kv.txt"), ",").collect()} == {"x": ["1", "2"], "y": ["3"]}


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_pcm_widths(width):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    full = {1: 128, 2: 1 << 15, 3: 1 << 23, 4: 1 << 31}[width]
    v = np.round(x * full).astype(np.int64)
    data = b"".join(int(k + 128).to_bytes(1, "little") if width == 1 else int(k).to_bytes(width, "little", signed=True) for k in v)
    raw = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000 * width, width, 8 * width) + b"data" + struct.pack("<I", len(data)) + data
    sr, y = audio.decode_wav(raw)
    assert sr == 8000 and np.allclose(x, y, atol=1 / 127)


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 100 * np.arange(8000) / 8000)
    y = audio.resample(x, 8000, 12_000)
    assert len(y) == 12_000 and np.allclose(y[200:-200], np.sin(2 * np.pi * 100 * np.arange(12_000) / 12_000)[200:-200], atol=0.01)
    m = audio.log_mel(x, 8000, 400, 160, 40)
    assert m.shape[0] == 40 and m.argmax(0)[5] == audio.mel_filters(40, 400, 8000)[:, 5].argmax()


def test_tensor_container(spark, tmp_path):
    x = np.arange(64, dtype=np.float32)
    path = str(tmp_path / "t.gguf")
    tensors.write_gguf(path, [("general.name", 8, "t"), ("a.b", 4, 7)], [("w", [32, 2], "Q8_0", codecs.quantize(x, "Q8_0")), ("v", [64], "F32", x.tobytes())])
    assert tensors.gguf_fields(path)[1] == ("a.b", 4, "7")
    spark.dataSource.register(tensors.GgufSource)
    rows = {r["name"]: r for r in spark.read.format("gguf").option("path", path).load().collect()}
    assert rows["v"]["shape"] == [64] and np.frombuffer(rows["v"]["data"], np.float32).tolist() == x.tolist()
    assert np.allclose(codecs.dequantize(bytes(rows["w"]["data"]), "Q8_0"), x, atol=0.5)
    one = spark.read.format("gguf").option("path", path).option("tensor", "w").option("data", "false").load().collect()
    assert len(one) == 1 and one[0]["data"] is None
    (tmp_path / "s.safetensors").write_bytes(struct.pack("<Q", len(h := json.dumps({"b": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "__metadata__": {}}).encode())) + h + b"\0" * 8)
    assert tensors.safetensors_header(str(tmp_path / "s.safetensors")) == [("b", "F32", [2], 8 + len(h), 8)]
    assert tensors.parameter_count([[32, 2], [64]]) == (128, "0.1K")


def test_options():
    assert pipeline.Options().check().bounds() == (8.0, 22.0)
    for bad in ({"least": 3.0}, {"least": 9.0, "most": 3.0}, {"tempo": 0}, {"formats": ("xyz",)}, {"least": 0.0, "most": 61.0}):
        with pytest.raises(pipeline.ConfigError):
            pipeline.Options(**bad).check()
    assert not pipeline.Options(mode="simple", step=0).quantizes and pipeline.Options(mode="dp", step=0).quantizes


def test_whole_plan_with_stub_models(spark):
    tone = np.sin(np.arange(3000) * 0.5).tolist()
    a = spark.createDataFrame([("s1", "m1", 1000, tone), ("s2", "m2", 1000, tone)], "source_id string, md5 string, sr int, samples array<float>")
    done = spark.createDataFrame([("m2", "k", "n", "p", 1, 1)], files.STATE)

    def recognize(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source_id": b["source_id"], "chunk_idx": b["chunk_idx"], "text": "hi 北京 欢迎"})

    def estimate(b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"source_id": s, "chunk_idx": c, "seq": [0, 1, 2], "dur": [0.5, 0.26, 0.5], "pitch": [60.0, 0.0, 62.0], "present": [True, False, True]}) for s, c in zip(b["source_id"], b["chunk_idx"], strict=True)])

    ref = spark.createDataFrame([("s1", list("北京欢迎你"))], "source_id string, ref array<string>")
    notes, chunks = pipeline.run(a, done, recognize, estimate, pipeline.Options(mode="simple"), ref)
    got = notes.orderBy("note_idx").collect()
    assert [(r["track_id"], r["onset"], r["lyric"]) for r in got] == [("s1", 0.0, "北"), ("s1", 0.75, "京")]
    assert [r["status"] for r in chunks.collect()] == ["exact match"]


def test_sessions_and_online_slices(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 2, 4, 20, 21)]
    d = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in silence.gap_sessions(d, "k", "t", "5 seconds", "1 minute").collect()) == [2, 3]
    assert sum(r["n"] for r in silence.tumbling_counts(d, "k", "t", "10 seconds", "1 minute").collect()) == 5
    levels = [1, 1, 0, 0, 0, 0, 1, 1, 0, 1]
    kind = "key string, frame bigint, level double, at timestamp"
    rows = [("a", i, float(v), i) for i, v in enumerate(levels)] + [("b", 0, 1.0, 7200)]  # an hour and more later, so that the watermark passes a's end
    frames = spark.createDataFrame(rows, "key string, frame bigint, level double, s bigint").selectExpr("key", "frame", "level", "timestamp_seconds(1700000000 + s) as at")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = silence.online_slices(stream, 0.5, 3).writeStream.format("memory").queryName("slices").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["key"], r["start"], r["end"]) for r in spark.table("slices").collect()) == [("a", 0, 2), ("a", 6, 10)]
