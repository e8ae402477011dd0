from __future__ import annotations

from collections import Counter

import corpus_pipeline
from strandline.llm import mixing, toxicity
from strandline.runtime import table

from .test_rules import brute_base
from .test_similar import brute


def test_stages_on_their_own_input(spark):
    """Each stage against a brute-force version on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    names = docs.columns
    clean = corpus_pipeline.quality(spark, docs, sf).cache()
    assert clean.columns == names
    assert all(not brute_base(r["text"])[5] for r in clean.collect())
    mild = corpus_pipeline.not_toxic(spark, clean, sf).cache()
    model = toxicity.fit(clean, labels)
    rows = clean.collect()
    want = [r["doc_id"] for r, s in zip(rows, model.score([r["text"] for r in rows]), strict=True) if s < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in mild.collect()) == sorted(want)
    one = corpus_pipeline.one_of_each(spark, mild, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in mild.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, n, c in brute(rows) if not n or d == c)
    mix = corpus_pipeline.mixed(spark, one, sf).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()}
    assert mix.columns == names
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({d: n for d, n in copies.items() if n})
    packed = corpus_pipeline.packed(spark, mix, sf).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == Counter({d: n for d, n in copies.items() if n})


def test_run_and_names(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
