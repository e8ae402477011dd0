from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from strandline.llm import mixing, quality_rules, sharding, url_filter
from strandline.runtime import table

WORD = r"[^\x20\x09-\x0D]+"


def brute_base(x):
    x = x or ""
    w = re.findall(WORD, x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def _bases(df):
    names = [f"_q_{c}" for c in quality_rules.RESULTS[:6]]
    return sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in df.collect())


def test_base_counts_on_awkward_rows(spark, awkward, labels):
    got = _bases(quality_rules.judge(awkward.select("doc_id", "text"), labels))
    assert got == sorted((str(r["doc_id"]), *brute_base(r["text"])) for r in awkward.collect())


def test_base_counts_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = _bases(quality_rules.judge(docs.select("doc_id", "text"), table(spark, sf, "labels")))
    assert got == sorted((str(r["doc_id"]), *brute_base(r["text"])) for r in docs.collect())


def _grams(text):
    """The hashed n-grams of a text: words, their last two characters, pairs of neighbours."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    link = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
    w = re.findall(WORD, text or "")
    hw = [h(x) for x in w]
    return [signed(x) for x in hw + [h(x[-2:]) for x in w] + [link(a, b) for a, b in zip(hw, hw[1:])]]


@pytest.mark.parametrize("most", [quality_rules.FILTER_BITS, 1 << 12])
def test_ratio_against_plain_counting(spark, sf, most, monkeypatch):
    """Every score and verdict from counting the same hashed n-grams in plain Python, also with a filter that is too small."""
    monkeypatch.setattr(quality_rules.trusted_rows, "__defaults__", (most,))
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    n = quality_rules.BUCKETS
    rows = [(r["doc_id"], [g % n for g in _grams(r["text"])]) for r in docs.collect()]
    raw, kept = Counter(), Counter()
    for d, gs in rows:
        raw.update(gs)
        kept.update(gs if d in good else [])
    w = {b: round(1e6 * math.log((kept[b] + 1) / (kept.total() + n) / ((c + 1) / (raw.total() + n)))) for b, c in raw.items()}
    want = {d: sum(w[b] for b in gs) / len(gs) / 1e6 if gs else None for d, gs in rows}
    for r in quality_rules.judge(docs, labels).collect():
        s = want[r["doc_id"]]
        assert r["_q_score"] == s or abs(r["_q_score"] - s) < 1e-12
        assert r["_q_kept"] == (not r["_q_base_failed"] and s is not None and s >= quality_rules.THRESHOLD)


def test_trusted_rows_are_those_with_a_label(spark, awkward, labels):
    d = spark.range(20_000).selectExpr("id as doc_id", "concat('t', id) as text")
    good = spark.range(0, 20_000, 7).selectExpr("id as doc_id", "1 as quality").unionByName(spark.range(0, 20_000, 3).selectExpr("id as doc_id", "0 as quality"))
    got = quality_rules.trusted_rows(d, good.unionByName(good))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 20_000, 7))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in quality_rules.trusted_rows(awkward, labels).collect()) == [1, 2, 3, 8, 10, 10]


def test_query_scores_word_pairs(spark, tmp_path):
    """The query's score is that of words, their ends and neighbouring words; other orders of the same words score lower."""
    rows = [(i, "alpha bravo carol delta eagle") for i in range(1, 9)] + [(9, "delta bravo eagle carol alpha"), (10, "stone"), (11, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality_rules.op3_quality_rules(spark, str(tmp_path)).collect()}
    grams = {}
    for d, t in rows:
        w = (t or "").split()
        grams[d] = w + [x[-2:] for x in w] + list(zip(w, w[1:]))
    raw, good = Counter(g for gs in grams.values() for g in gs), Counter(g for d in range(1, 9) for g in grams[d])
    n = quality_rules.BUCKETS
    weight = {g: math.log((good[g] + 1) / (good.total() + n) / ((c + 1) / (raw.total() + n))) for g, c in raw.items()}
    assert got[11] is None and got[9] < got[1]
    assert all(abs(got[d] - sum(map(weight.get, gs)) / len(gs)) < 1e-5 for d, gs in grams.items() if gs)


def test_clean_stays_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_rules.op3_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    clean = out[(out["quality"] == 1) & ~out["base_failed"]]
    assert clean["kept"].mean() > 0.99
    assert out[out["quality"] == 0]["kept"].mean() < 0.05


def test_rules_without_labels_and_rows(awkward, empty, no_labels, labels):
    kept = quality_rules.keep(awkward, no_labels)
    assert kept.columns == awkward.columns
    want = [r["doc_id"] for r in awkward.collect() if not brute_base(r["text"])[5]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))
    assert quality_rules.keep(empty, labels).count() == 0


def fill_water(sizes, weights, limit=3):
    """Step by step: share what is left, stop those above their limit, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in done]
        left, weight = total - sum(done.values()), sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / weight > limit * sizes[n] + 1e-9]
        if not over:
            return {n: done.get(n, left * w[n] / weight if weight else 0) for n in names}
        done |= {n: limit * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 10, "b": 10, "c": 10, None: 70}, {"a": 0, "b": 9}, {"z": 100, "y": 1, "x": 1, "w": 1, "v": 400}])
def test_targets_by_resharing(spark, sizes):
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    want = fill_water(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_agrees_with_sql(spark, sf):
    got = mixing.op4_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(mixing.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_mix_of_awkward_rows(awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["copies"] <= 3
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] <= 3 * r["source_size"] for r in rows)
    taken = mixing.resample(awkward)
    assert taken.columns == awkward.columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.resample(empty).count() == 0


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("n,hot", [(5, 0), (300, 0), (3000, 1500)])
def test_shards_are_the_best_contiguous_ones(spark, n, hot):
    import random

    r = random.Random(n)
    texts = [f"text {i} " + "y" * r.randint(0, 300) for i in range(n)] + ["the same text"] * hot + [texts for texts in ["twin"] * 3]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = sharding.shard(d).toPandas()
    assert len(out) == len(texts)
    keyed = d.selectExpr("doc_id", "xxhash64(text) as key").toPandas()
    groups = Counter()
    for k, s in zip(keyed.sort_values("doc_id")["key"], out.sort_values("doc_id")["size"], strict=True):
        groups[int(k) % (1 << 64)] += s
    assert out.groupby("shard")["size"].sum().max() == least_capacity([groups[k] for k in sorted(groups)], 8)
    by_text = out.assign(t=[texts[i] for i in out["doc_id"]])
    assert (by_text.groupby("t")["shard"].nunique() == 1).all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_shards_of_awkward_rows(awkward, empty):
    import zlib

    out = sharding.shard(awkward).collect()
    assert len(out) == awkward.count()
    text = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    for r in out:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    where = {r["doc_id"]: r["shard"] for r in out}
    assert where[1] == where[2] and where[4] == where[5]
    assert sharding.shard(empty).count() == 0


def test_urls_agree_with_sql(spark, sf):
    rows = [(-1, None, "x"), (-2, "no scheme", "x"), (-3, "HTTP://WWW.Example.COM/en/7x?q#f", "x"), (-4, "a://b://org/es/", "x"), (-5, "http://com/en/", "x"), (-5, "http://com/en/", "x"), (-6, "http://xcom/en/", "x"), (None, "http://deep.sub.example.net/de/8/9", "x"), (-7, "http://", "x"), (-8, "s://Net/DE/", "x")]
    pages = table(spark, sf, "pages").unionByName(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = url_filter.judge(pages, url_filter.rule_table(spark)).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.execute(url_filter.OP7_SQL).df()
    key = lambda d: sorted(map(str, set(d[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(d.notna(), None).itertuples(index=False, name=None))))
    assert key(got) == key(want) and len(got) == pages.count()


def test_bloom_filter_has_no_false_negatives_and_the_join_removes_the_rest(spark, monkeypatch):
    rules = spark.createDataFrame([(f"h{i}.com/p{i % 7}", "block") for i in range(3000)], "key string, verdict string")
    other = spark.range(20_000).selectExpr("concat('x', id) as key")
    for most in (url_filter.BROADCAST_ROWS, 10):  # sent to all, or dealt by block
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
        f = url_filter.build_filter(rules, "key", 3000)
        assert url_filter.maybe_in(rules.select("key"), "key", f).count() == 3000
        assert url_filter.maybe_in(other, "key", f).count() < 400
    pages = spark.createDataFrame([(1, "http://h5.com/p5/x"), (2, "http://h5.com/p6"), (3, "http://s.h9.com/p2")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}
    none = spark.createDataFrame([], "key string, verdict string")
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_listed_urls_are_made_canonical(spark):
    rules = spark.createDataFrame([("HTTPS://WWW.Example.COM/A/b?q=1#f", "block"), ("www.example.com/A/", "allow"), ("bare.org", "block"), ("bare.org", "allow"), ("", "block"), (None, "block")], "key string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.example.com/A/b/c"), (2, "http://www.example.com/A/c"), (3, "ftp://x.BARE.org"), (4, "http://example.com/A/b")], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("www.example.com/A/b", "block"), 2: ("www.example.com/A/", "allow"), 3: ("bare.org", "block"), 4: (None, "allow")}


@pytest.mark.parametrize("most", [url_filter.BROADCAST_ROWS, 100])
def test_a_long_list_with_many_path_lengths(spark, most, monkeypatch):
    """100 000 rules with paths of 500 lengths, and very long URLs, against plain look-ups; also where no side is small enough to be sent."""
    import random

    from strandline import runtime

    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", most)
    r = random.Random(5)
    host = lambda: ".".join(r.choice(["a", "b", "cd", "net", f"h{r.randrange(4000)}"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.choice([0, 1, 2, 3, 4, r.randrange(500)])))
    rules = {host() + path(): r.choice(["allow", "block"]) for _ in range(100_000)}
    known = list(rules)
    urls = ["http://" + r.choice(["", "w.", "a.b."]) + r.choice(known) + r.choice(["", "x", "?q", "/y#z"]) for _ in range(1500)] + [f"http://{host()}{path()}" for _ in range(500)] + ["http://cd.net/" + "xy/" * 30_000] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.judge(pages, spark.createDataFrame(list(rules.items()), "key string, verdict string")).collect()}
    lengths = sorted({len(k) - k.index("/") for k in known})
    for i, u in enumerate(urls):
        h, _, p = re.split(r"[?#]", u[7:])[0].partition("/")
        p, parts = "/" + p if _ else "", h.split(".")
        fits = [k for j in range(len(parts)) for n in lengths if n <= len(p) and (k := ".".join(parts[j:]) + p[:n]) in rules]
        want = max(fits, key=lambda k: (len(k), k), default=None)
        assert got[i] == (want, rules.get(want, "allow")), u
