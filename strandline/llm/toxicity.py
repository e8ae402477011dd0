"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams (3 to 6 characters, lower case,
a space at either end). Each has a ratio r = log of its smoothed share among
toxic documents over that among others; features that are rare, or whose ratio
is small or within chance, are left out. Logistic regression is fitted on presence times r.
The score is the logistic of the sum of weights, with the intercept moved from
the balanced sample to the class shares of all rows that may be learned from.

Training reads a bounded sample: ``PER_CLASS`` documents of each class. Scoring
reads every whole text in one narrow pass; the weights are a table of 2**BITS
numbers, whatever the size of the corpus.

Defined cases: null and empty text has no n-grams and scores the intercept;
repeated rows score alike; without labels of both classes every score is the
share of toxic labels (0 without labels), an empty table gives an empty result; extra columns are ignored.
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
from strandline.runtime import durable, ship, table, tidy

BITS = 20
SIZES = (3, 4, 5, 6)
PER_CLASS = 2_000
#: Documents that must have a feature, the least |r|, and the least |r| in standard errors.
MIN_DOCS, MIN_RATIO, MIN_SURE = 3, 1.0, 3.0
PENALTY = 1e-3
MOD, HELD = 3, 1
THRESHOLD = 0.7


def _distinct(texts: list[str | None], wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts in the run, text of each feature, feature), once for each text and feature; only wanted ones, if given."""
    for cp, ends in blocks(texts, pad=" ", lower=True):
        docs, feats = [], []
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for n in SIZES:
            h = gram_hashes(cp, n, BITS)
            whole = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]  # not across two texts
            at = np.flatnonzero(whole if wanted is None else whole & wanted[h])
            docs.append(owner[at]), feats.append(h[at])
        pair = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | np.concatenate(feats))
        yield len(ends) - 1, pair >> BITS, pair & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, documents of class 0 and of class 1 that have it: partial sums of a batch."""
    for b in batches:
        y, at = b.column(1).to_numpy(zero_copy_only=False), 0
        n = np.zeros((2, 1 << BITS), np.int64)
        for size, doc, feat in _distinct(b.column(0).to_pylist(), None):
            for c in (0, 1):
                n[c] += np.bincount(feat[y[at + doc] == c], minlength=1 << BITS)
            at += size
        some = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], ["feat", "n0", "n1"])


def _bags(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Wanted features of each text, with its label."""
    keep = np.zeros(1 << BITS, bool)
    keep[wanted] = True
    for b in batches:
        rows = []
        for n, doc, feat in _distinct(b.column(0).to_pylist(), keep):
            cuts = np.searchsorted(doc, np.arange(n + 1))
            rows += [feat[a:z].astype("<u4").tobytes() for a, z in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["feats", "label"])


class Model:
    """weights over 2**BITS features (0: left out) and the intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.wanted = weights != 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for n, doc, feat in _distinct(texts, self.wanted):
            out.append(np.bincount(doc, self.weights[feat], minlength=n))
        return sigmoid(np.concatenate(out) + self.bias) if out else np.zeros(0)


def log_count_ratios(feats: np.ndarray, n0: np.ndarray, n1: np.ndarray, total0: int, total1: int) -> tuple[np.ndarray, np.ndarray]:
    """Features worth keeping and their ratios; ``total``: sums of counts over all features of a class. The median ratio is taken as neutral."""
    size = 1 << BITS
    ratio = np.log((n1 + 1) / (total1 + size)) - np.log((n0 + 1) / (total0 + size))
    ratio = ratio - np.median(ratio) if len(ratio) else ratio
    error = np.sqrt(1 / (n0 + 1) + 1 / (n1 + 1))
    used = (np.abs(ratio) >= MIN_RATIO) & (np.abs(ratio) >= MIN_SURE * error)
    return feats[used], ratio[used]


def constant(counts: dict[int, int]) -> Model:
    seen = sum(counts.values())
    share = counts.get(1, 0) / seen if seen else 0.0
    return Model(np.zeros(1 << BITS), -60.0 if share == 0 else 60.0 if share == 1 else math.log(share / (1 - share)))


def fit_rows(bags: list[np.ndarray], y: np.ndarray, counts: dict[int, int], feats: np.ndarray, r: np.ndarray) -> Model:
    """Logistic regression on presence times ratio. ``bags``: kept features of each document."""
    if not (counts.get(0) and counts.get(1) and (y == 0).any() and (y == 1).any()):
        return constant(counts)
    col = np.searchsorted(feats, np.concatenate(bags)) if len(feats) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bags)), [len(k) for k in bags])
    w, b, gw, gb = np.zeros(len(r)), 0.0, np.full(len(r), 1e-8), 1e-8
    for _ in range(200):  # AdaGrad on the whole sample
        p = sigmoid(np.bincount(row, (w * r)[col], minlength=len(y)) + b)
        d = (p - y) / len(y)
        grad, gradb = np.bincount(col, d[row], minlength=len(r)) * r + PENALTY * w, d.sum()
        gw += grad**2
        gb += gradb**2
        w -= 0.2 * grad / np.sqrt(gw)
        b -= 0.2 * gradb / math.sqrt(gb)
    weights = np.zeros(1 << BITS)
    weights[feats] = w * r
    # the sample is balanced; the labels are not
    shift = math.log(counts[1] / counts[0]) - math.log((y == 1).sum() / (y == 0).sum())
    return Model(weights, b + shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    ship(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, "toxic", MOD, HELD, per_class)
    sample = durable(sample)  # at most 2 * per_class rows
    n = sample.mapInArrow(lambda b: tidy(_counts(b)), "feat bigint, n0 bigint, n1 bigint").groupBy("feat").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = durable(n)
    total = n.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("t1")).first()
    common = n.where(F.col("n0") + F.col("n1") >= MIN_DOCS).orderBy("feat").toArrow()  # at most 2**BITS rows
    feats, r = log_count_ratios(*(common.column(c).to_numpy() for c in ("feat", "n0", "n1")), total["t0"], total["t1"])
    got = sample.mapInArrow(lambda b: _bags(b, feats), "feats binary, label int").toArrow()
    bags = [np.frombuffer(x, "<u4").astype(np.int64) for x in got.column("feats").to_pylist()]
    return fit_rows(bags, np.array(got.column("label").to_pylist(), float), counts, feats, r)


def _scorer(spark: SparkSession, model: Model):
    """A function that scores texts on any worker."""
    at = np.flatnonzero(model.wanted)
    sent = spark.sparkContext.broadcast((at, model.weights[at], model.bias))  # at most 2**BITS numbers

    def scores(texts: pa.Array) -> np.ndarray:
        at, w, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[at] = w
        return Model(weights, bias).score(texts.to_pylist())

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    scores = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, unchanged."""
    scores, at = _scorer(docs.sparkSession, fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at)) < threshold))

    return docs.mapInArrow(lambda b: tidy(run(b)), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), MOD) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
