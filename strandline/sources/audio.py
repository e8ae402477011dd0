"""PCM audio: decoding, resampling and writing with NumPy alone."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.runtime import ship


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono float samples of 8, 16, 24 or 32 bit PCM; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as w:
        n, width, sr, data = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    elif width in (2, 4):
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"PCM of {width} bytes")
    return sr, x.reshape(-1, n).mean(1).astype(np.float32)


def resample(x: np.ndarray, sr: int, to: int, taps: int = 16) -> np.ndarray:
    """Windowed-sinc resampling by a rational factor."""
    if sr == to or not len(x):
        return x.astype(np.float32)
    g = gcd(sr, to)
    up, down = to // g, sr // g
    n = -(-len(x) * up // down)
    at = np.arange(n) * (down / up)
    cut = min(1.0, up / down)
    near = np.floor(at).astype(np.int64)
    out, norm = np.zeros(n), np.zeros(n)
    half = int(np.ceil(taps / cut))
    for k in range(-half + 1, half + 1):
        i = near + k
        d = at - i
        w = np.sinc(d * cut) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0) * cut
        ok = (i >= 0) & (i < len(x))
        out += np.where(ok, x[np.clip(i, 0, len(x) - 1)], 0) * w
        norm += w
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def encode_wav(x: np.ndarray, sr: int) -> bytes:
    """16-bit mono."""
    data = (np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, sr, sr * 2, 2, 16) + b"data" + struct.pack("<I", len(data))
    return head + data


def load(files: DataFrame, sr: int = 44_100, start: float = 0.0, duration: float | None = None) -> DataFrame:
    """``files`` (path, content) to path, sr, samples, error. A file that does not decode keeps its row, with the reason."""
    ship(files.sparkSession)

    def one(raw: bytes) -> tuple[list[float] | None, str | None]:
        try:
            rate, x = decode_wav(raw)
        except (wave.Error, ValueError, EOFError) as e:
            return None, str(e)
        x = resample(x, rate, sr)
        a = round(start * sr)
        return x[a : None if duration is None else a + round(duration * sr)].tolist(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "sr": sr, "samples": [g[0] for g in got], "error": [g[1] for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, sr int, samples array<float>, error string")


def mel_filters(n: int, fft: int, sr: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters on the HTK mel scale, [n, fft / 2 + 1]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(low), mel(high or sr / 2), n + 2) / 2595) - 1)
    f = np.linspace(0, sr / 2, fft // 2 + 1)
    rise = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, sr: int = 16_000, fft: int = 400, hop: int = 160, n: int = 128) -> np.ndarray:
    """Power mel in log10, no lower than 8 under the peak, scaled to about -1..1: [n, frames]. Ends are mirrored."""
    pad = np.pad(x.astype(float), fft // 2, mode="reflect" if len(x) > fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(pad, fft)[::hop] * np.hanning(fft + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    m = np.log10(np.maximum(mel_filters(n, fft, sr) @ power.T, 1e-10))
    return (np.maximum(m, m.max() - 8) + 4) / 4
