"""Framewise decoding of one utterance at a time: alignment by dynamic programming, edges, word assembly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.runtime import ship

SILENCE = 0


def log_softmax(x: np.ndarray, axis: int = 0) -> np.ndarray:
    x = x - x.max(axis=axis, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=axis, keepdims=True))


def edge_probabilities(edge_logits: np.ndarray) -> np.ndarray:
    """Chance of a phone edge at each frame: of this frame and the one before, at most 1."""
    p = 1 / (1 + np.exp(-edge_logits))
    return np.clip(p + np.concatenate([[0.0], p[:-1]]), 0, 1)


def forced_path(lp: np.ndarray, edge: np.ndarray, phones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phone place of each frame, and the path's score there.

    ``lp``: [phones, frames] log-probability of each expected phone. Moves are to stay,
    to go on, or to skip one silence; leaving a phone pays with the best frame it had,
    scaled by frames per phone. Ties go to the move named first."""
    s, t = lp.shape
    quiet = phones == SILENCE
    # what may be skipped: a silence, or the last phone
    skippable = np.zeros(s, bool)
    skippable[2:] = quiet[1:-1] | (np.arange(2, s) - 1 >= s - 1)
    score = np.full(s, -np.inf)
    score[0] = lp[0, 0]
    if s > 1 and quiet[0]:
        score[1] = lp[1, 0]
    peak = np.where(quiet, 0.0, lp[:, 0])
    stay_, leave = np.log(1 - edge + 1e-6), np.log(edge + 1e-6)
    moves, scores = np.zeros((t, s), np.int8), np.empty((t, s))
    scores[0] = score
    bonus = t / s
    for k in range(1, t):
        ways = np.full((3, s), -np.inf)
        ways[0] = score + lp[:, k] + stay_[k]
        ways[1, 1:] = score[:-1] + lp[:-1, k] + leave[k] + peak[:-1] * bonus
        ways[2, 2:] = np.where(skippable[2:], score[:-2] + lp[:-2, k] + leave[k] + peak[:-2] * bonus, -np.inf)
        moves[k] = ways.argmax(0)
        score = ways[moves[k], np.arange(s)]
        peak = np.where(moves[k] == 0, np.maximum(peak, lp[:, k]), lp[:, k])
        peak[quiet] = 0.0
        scores[k] = score
    at = s - 2 if s > 1 and quiet[-1] and score[s - 2] > score[s - 1] else s - 1
    path = np.empty(t, np.int64)
    for k in range(t - 1, -1, -1):
        path[k] = at
        at -= int(moves[k, at]) if k else 0
    return path, scores[np.arange(t), path]


def align_utterance(logits: np.ndarray, edge_logits: np.ndarray, phones: list[int], frame: float, allowed: list[int] | None = None) -> pd.DataFrame:
    """ph_idx, start, end (seconds), confidence. ``logits``: [vocabulary, frames]; phones outside ``allowed`` are masked. Boundaries are moved inside the frame by the edge's slope."""
    x = logits.astype(float).copy()
    if allowed is not None:
        out = np.ones(len(x), bool)
        out[[SILENCE, *allowed]] = False
        x[out] -= 1e9
    ids = np.array(phones)
    lp = log_softmax(x)[ids]
    edge = edge_probabilities(edge_logits.astype(float))
    path, score = forced_path(lp, edge, ids)
    first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    slope = np.concatenate([np.diff(edge), [0.0]])
    at = np.clip(first + np.clip(slope[first] / 2, -0.5, 0.5), 0, None) * frame
    at[0] = 0.0
    sure = np.exp(np.concatenate([[score[0]], np.diff(score)]))
    return pd.DataFrame({"ph_idx": path[first], "start": at, "end": np.append(at[1:], len(path) * frame), "confidence": [float(sure[a:z].mean()) for a, z in zip(first, np.append(first[1:], len(path)), strict=True)]})


def words_of(aligned: pd.DataFrame, word_of: list[int], words: list[str]) -> pd.DataFrame:
    """Phones put together to words; word -1 is silence."""
    d = aligned.assign(word_idx=[word_of[i] for i in aligned["ph_idx"]])
    d = d[d["word_idx"] >= 0]
    g = d.groupby("word_idx", as_index=False).agg(start=("start", "min"), end=("end", "max"))
    return g.assign(text=[words[i] for i in g["word_idx"]])


def decode_utterances(rows: DataFrame, frame: float = 0.02) -> DataFrame:
    """One row per utterance (utt, logits, edges, phones) to its phones: utt, ph_idx, start, end, confidence. No shuffle: an utterance is a row."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for u, lg, e, p in zip(b["utt"], b["logits"], b["edges"], b["phones"], strict=True):
                out.append(align_utterance(np.stack([np.asarray(r, float) for r in lg]), np.asarray(e, float), [int(i) for i in p], frame).assign(utt=u))
            if out:
                yield pd.concat(out)[["utt", "ph_idx", "start", "end", "confidence"]]

    return rows.select("utt", "logits", "edges", "phones").mapInPandas(run, f"utt {dict(rows.dtypes)['utt']}, ph_idx bigint, start double, end double, confidence double")


def collapse_ids(ids: list[int], vocab: dict[int, str], blank: int = 0) -> list[str]:
    """CTC best path: repeats and blanks go; unknown ids become ``<unk>``."""
    return [vocab.get(c, "<unk>") for p, c in zip([None, *ids[:-1]], ids, strict=True) if c != p and c != blank]


def best_path(scores: np.ndarray, vocab: dict[int, str], blank: int = 0) -> list[str]:
    """Integer outputs are ids already; floats are taken at their largest."""
    ids = scores if np.issubdtype(scores.dtype, np.integer) else scores.argmax(-1)
    return collapse_ids([int(i) for i in ids], vocab, blank)


def infer(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """The model hook: ``model`` maps Arrow batches; what ``setup`` returns is made once per task and given as second argument."""
    ship(rows.sparkSession)

    def run(batches):
        session = setup() if setup else None
        for b in batches:
            yield model(b, session) if setup else model(b)

    return rows.mapInPandas(run, schema)
