"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages: consecutive runs of ``PASSAGE`` characters. A
passage's input is the square root of its hashed character-trigram counts, scaled
to length 1 if it is not short, and two numbers on how much it repeats itself. One layer encodes it: h = tanh(x E + e). Gated attention weighs
passages: a = softmax over the bag of w . (tanh(h V) * sigmoid(h U)), and the
score of the document is the logistic of c . sum(a h) + d. All weights are
learned together from document labels, by Adam on a bounded sample
(``PER_CLASS`` documents of each class, of each ``FIT_PASSAGES`` passages at most, evenly
spaced: 200 MB in the worst case); the intercept then moves to the class shares of all
rows that may be learned from. Scoring takes every passage of every whole text, with
no cap, in one narrow pass.

Defined cases: null and empty text is one passage without trigrams and gets a
score like any other; repeated rows score alike; without labels of both classes
every score is the share of label 1 (0 without labels); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.chars import blocks, gram_hashes, labelled_sample, sigmoid
from strandline.llm.words import crc_remainder
from strandline.runtime import ship, table

PASSAGE = 512
BITS = 10
#: Trigrams from which on a passage counts as full.
FULL = 300
HIDDEN, GATE = 24, 12
PER_CLASS, FIT_PASSAGES = 1_500, 32
EPOCHS, BAGS = 12, 32
MOD, HELD = 4, 2
THRESHOLD = 0.7


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first passage of each text and the end, trigram counts of each passage), for runs of texts."""
    for cp, ends in blocks(texts):
        size = np.diff(ends)
        n = np.maximum(1, -(-size // PASSAGE))
        first = np.concatenate([[0], np.cumsum(n)])
        for lo, hi in _runs(n):  # the counts of about 2000 passages at a time, but whole texts
            a, z = ends[lo], ends[hi]
            owner = np.repeat(np.arange(lo, hi), size[lo:hi])
            of = first[owner] - first[lo] + (np.arange(a, z) - ends[owner]) // PASSAGE
            h = gram_hashes(cp[a:z], 3, BITS)
            same = of[: len(h)] == of[2 : 2 + len(h)]
            rows = int(first[hi] - first[lo])
            x = np.bincount((of[: len(h)][same].astype(np.int64) << BITS) | h[same], minlength=rows << BITS)
            yield first[lo : hi + 1] - first[lo], x.reshape(rows, 1 << BITS)


def _runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, k in enumerate(n.tolist()):
        if total and total + k > 2000:
            yield lo, i
            lo, total = i, 0
        total += k
    if lo < len(n):
        yield lo, len(n)


def inputs(counts: np.ndarray) -> np.ndarray:
    """Length 1 for full passages; short ones are shorter vectors, as they say less. Two columns tell how much a passage repeats itself."""
    x = counts.astype(np.float32)
    full = np.maximum(x.sum(1, keepdims=True), FULL)
    repeats = np.maximum(x - 2, 0).sum(1, keepdims=True) / full
    focus = np.sqrt((x * x).sum(1, keepdims=True)) / full
    return np.concatenate([np.sqrt(x / full), repeats, focus], axis=1)


class Model:
    """Encoder, gated attention and the classifier on the weighted passage."""

    NAMES = ("E", "e", "V", "U", "w", "c", "d")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        shapes = {"E": ((1 << BITS) + 2, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        spread = {"E": 0.05, "V": 0.3, "U": 0.3, "w": 0.3, "c": 0.3}  # what training does not touch says next to nothing
        return cls({k: (r.normal(0, spread[k], s) if k in spread else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        n = np.diff(first)
        top = np.maximum.reduceat(s, first[:-1])
        a = np.exp(s - np.repeat(top, n))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, n = self.p, self.forward(x, first), np.diff(first)
        d = ((f["y"] - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        ga = (dz * f["h"]).sum(1)
        ds = f["a"] * (ga - np.repeat(np.add.reduceat(f["a"] * ga, first[:-1]), n))
        dg = ds[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        return {"E": x.T @ de, "e": de.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (ds[:, None] * f["v"] * f["u"]).sum(0), "c": d @ f["z"], "d": np.array([d.sum()])}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [self.forward(inputs(x), first)["y"] for first, x in passages(texts)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def fit_rows(bags: list[np.ndarray], y: np.ndarray, counts: dict[int, int], epochs: int = EPOCHS) -> Model:
    """``bags``: passage-by-trigram counts of each document."""
    m, seen = Model.fresh(), sum(counts.values())
    if not (counts.get(0) and counts.get(1) and (y == 0).any() and (y == 1).any()):
        share = counts.get(1, 0) / seen if seen else 0.0
        m.p["c"][:] = 0
        m.p["d"][:] = -60 if share == 0 else 60 if share == 1 else math.log(share / (1 - share))
        return m
    one, two = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    r, step = np.random.default_rng(11), 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for lo in range(0, len(bags), BAGS):
            some = order[lo : lo + BAGS]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            g = m.gradient(inputs(np.concatenate([bags[i] for i in some])), first, y[some])
            step += 1
            for k in Model.NAMES:  # Adam
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                m.p[k] -= (0.01 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    m.p["d"] += np.float32(math.log(counts[1] / counts[0]) - math.log((y == 1).sum() / (y == 0).sum()))
    return m


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for first, x in passages(b.column(0).to_pylist()):
            x = np.minimum(x, 65535).astype("<u2")
            for a, z in zip(first.tolist(), first[1:].tolist(), strict=False):
                some = np.linspace(a, z - 1, min(z - a, FIT_PASSAGES)).round().astype(int)
                rows.append(x[some].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    ship(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, "quality", MOD, HELD, per_class)
    got = sample.mapInArrow(_bags, "bag binary, label int").toArrow()  # at most 2 * per_class rows
    bags = [np.frombuffer(x.as_buffer(), "<u2").reshape(-1, 1 << BITS) for x in got.column("bag").combine_chunks()] if got.num_rows else []
    return fit_rows(bags, np.array(got.column("label").to_pylist(), np.float32), counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), MOD) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
