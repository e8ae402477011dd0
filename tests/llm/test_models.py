from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality_model, toxicity
from strandline.llm.chars import labelled_sample
from strandline.runtime import table

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query,target,mod,held", [(toxicity.op10_toxicity, "toxic", 3, 1), (quality_model.op2_quality_classifier, "quality", 4, 2)])
def test_held_out_accuracy(spark, query, target, mod, held):
    out = query(spark, SF)
    assert out.count() == table(spark, SF, "documents").count()
    d = out.join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert ((d["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod) == held) == d["held_out"]).all()
    assert d["score"].between(0, 1).all() and ((d["score"] >= 0.7).astype(int) == d["predicted"]).all()
    h = d[d["held_out"]]
    # a few hundred toxic documents to learn from here
    assert (h[h[target] == 0]["predicted"] == 0).mean() > 0.95
    assert (h[h[target] == 1]["predicted"] == 1).mean() > 0.7


@pytest.mark.parametrize("model,target,mod,held", [(toxicity, "toxic", 3, 1), (quality_model, "quality", 4, 2)])
def test_held_out_labels_are_never_read(spark, model, target, mod, held):
    """Turning the held-out labels around changes no score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    hidden = f"pmod(crc32(cast(cast(doc_id as string) as binary)), {mod}) = {held}"
    turned = labels.selectExpr("doc_id", f"if({hidden}, 1 - {target}, {target}) as {target}")
    a, b = model.fit(docs, labels), model.fit(docs, turned)
    texts = ["a plain text", "", None]
    assert np.allclose(a.score(texts), b.score(texts))


@pytest.mark.parametrize("model", [toxicity, quality_model])
def test_awkward_rows(spark, model, awkward, empty, labels, no_labels):
    for lab in (labels, no_labels):
        m = model.fit(awkward, lab)
        rows = model.score(awkward, m).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(by[10]) == 1 and by[4] == by[5]
        assert model.score(empty, m).count() == 0
    assert model.fit(empty, labels).score(["x"]).shape == (1,)


def test_toxicity_keeps_rows_unchanged(spark, awkward, labels, empty):
    kept = toxicity.keep(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    assert toxicity.keep(empty, labels).count() == 0


def test_scores_do_not_depend_on_company():
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abc de!%"), n)) for n in (0, 1, 3, 511, 512, 513, 9000, 40)]
    m = quality_model.Model.fresh()
    assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts], atol=1e-5)
    w = np.zeros(1 << toxicity.BITS)
    w[r.integers(0, len(w), 5000)] = r.normal(size=5000)
    t = toxicity.Model(w, 0.1)
    assert np.allclose(t.score(texts), [t.score([x])[0] for x in texts])


def test_gradient_is_the_slope(monkeypatch):
    monkeypatch.setattr(quality_model, "BITS", 4)
    r = np.random.default_rng(1)
    m = quality_model.Model.fresh(3)
    m.p = {k: v.astype(np.float64) + r.normal(size=v.shape) * 0.2 for k, v in m.p.items()}
    x, first, y = np.abs(r.normal(size=(7, 18))), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, first)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m.gradient(x, first, y)
    for k in m.NAMES:
        at = tuple(r.integers(0, s) for s in m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5


def _hash(gram, n, bits):
    h = 0x9E3779B1 * n & 0xFFFFFFFF
    for c in gram:
        h = (h * 0x85EBCA6B + ord(c)) & 0xFFFFFFFF
        h ^= h >> 13
    return (h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - bits)


def _attended(p, text):
    """The score of one text from its passages, one number at a time."""
    text = text or ""
    passages = [text[i : i + 512] for i in range(0, len(text), 512)] or [""]
    hidden, says = [], []
    for q in passages:
        counts = Counter(_hash(q[i : i + 3], 3, quality_model.BITS) for i in range(len(q) - 2))
        full = max(sum(counts.values()), quality_model.FULL)
        x = np.zeros((1 << quality_model.BITS) + 2)
        for g, c in counts.items():
            x[g] = math.sqrt(c / full)
        x[-2], x[-1] = sum(max(c - 2, 0) for c in counts.values()) / full, math.sqrt(sum(c * c for c in counts.values())) / full
        h = np.tanh(x @ p["E"] + p["e"])
        gate = 1 / (1 + np.exp(-(h @ p["U"])))
        hidden.append(h)
        says.append(float((np.tanh(h @ p["V"]) * gate) @ p["w"]))
    weight = np.exp(np.array(says) - max(says))
    z = sum(w * h for w, h in zip(weight / weight.sum(), hidden))
    return 1 / (1 + math.exp(-(float(z @ p["c"]) + float(p["d"][0]))))


def test_quality_scores_from_single_passages(spark, awkward):
    sf = "/root/testdata/sf0.001"
    m = quality_model.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    for docs in (table(spark, sf, "documents"), awkward):
        texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
        got = docs.join(quality_model.score(docs, m).withColumnRenamed("doc_id", "_d"), docs["doc_id"].eqNullSafe(F.col("_d"))).select("doc_id", "text", "score").collect()
        assert len(got) >= len(texts)
        for r in got:
            assert abs(r["score"] - _attended(m.p, r["text"])) < 1e-4


def test_fitting_takes_a_bounded_number_of_passages(spark):
    rows = [(i, ("word%d " % (i % 7)) * (20_000 if i < 2 else 30), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows]), pa.array([y for *_, y in rows], pa.int32())], ["text", "label"])
    bags = next(quality_model._bags(iter([batch]))).column(0).to_pylist()
    assert max(map(len, bags)) == 2 * quality_model.FIT_PASSAGES << quality_model.BITS
    assert docs.count() == len(bags)


def _features(text):
    t = " " + text.lower() + " " if text else ""
    return {_hash(t[i : i + n], n, toxicity.BITS) for n in toxicity.SIZES for i in range(len(t) - n + 1)}


def test_toxicity_from_plain_counts_and_sums(spark, awkward):
    """Feature counts, ratios and the choice of features from sets and dicts; scores as sums of weights."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    m = toxicity.fit(docs, labels)
    sample, counts = labelled_sample(docs, labels, "toxic", toxicity.MOD, toxicity.HELD, toxicity.PER_CLASS)
    usable = [r for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    assert counts == Counter(r["toxic"] for r in usable)
    rows = [(_features(r["text"] or ""), r["_label"]) for r in sample.collect()]
    assert len(rows) == len({r["doc_id"] for r in usable})
    n = [Counter(), Counter()]
    for feats, y in rows:
        n[y].update(feats)
    total, size = [c.total() for c in n], 1 << toxicity.BITS
    often = sorted(f for f in n[0] | n[1] if n[0][f] + n[1][f] >= toxicity.MIN_DOCS)
    ratio = {f: math.log((n[1][f] + 1) / (total[1] + size)) - math.log((n[0][f] + 1) / (total[0] + size)) for f in often}
    middle = float(np.median(list(ratio.values())))
    sure = {f: math.sqrt(1 / (n[0][f] + 1) + 1 / (n[1][f] + 1)) for f in often}
    used = {f for f in often if abs(ratio[f] - middle) >= max(toxicity.MIN_RATIO, toxicity.MIN_SURE * sure[f])}
    assert used == set(np.flatnonzero(m.weights).tolist())
    for r in [*docs.collect(), *awkward.collect()]:
        x = sum(m.weights[f] for f in _features(r["text"] or "")) + m.bias
        assert abs(m.score([r["text"]])[0] - 1 / (1 + math.exp(-max(-60, min(60, x))))) < 1e-9
