from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from strandline.llm import jaccard_join as J
from strandline.llm import lattice_dedup as L
from strandline.llm import queries
from strandline.llm.components import components
from strandline.llm.joins import hot_keys, id_filter, spread_join
from strandline.llm.shingles import shingle_sets
from strandline.runtime import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """(row, set size, smallest doc_id of the component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (low.get(r) is None or d < low[r]):
            low[r] = d
    return [(d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def _got(df):
    return sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar_components(df).collect())))


def test_sets_equal_plain_python(awkward):
    texts = [r["text"] for r in awkward.collect()]
    flat = [s for some in shingle_sets(pa.array(texts, pa.string()), 5) for s in some]
    assert [len(s) for s in flat] == [len(shingles(t)) for t in texts]


def test_long_text_in_stretches(monkeypatch):
    import strandline.llm.shingles as S

    text = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    whole = [s for some in shingle_sets(pa.array([text]), 5) for s in some][0]
    monkeypatch.setattr(S, "STRIDE", 1000)
    parts = [s for some in shingle_sets(pa.array([text]), 5) for s in some][0]
    assert (whole == parts).all()


def test_components_of_awkward_rows(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert _got(awkward) == sorted(map(str, brute(rows)))
    assert J.similar_components(empty).count() == 0 and J.keep_one(empty).count() == 0
    kept = J.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 2 not in ids and 3 not in ids and {1, 4, 5, 6, 7, None} <= set(ids)


def edited(words, r, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        k = r.randrange(len(out))
        out[k] = f"z{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("sizes,small", [((4, 12), 64), ((5, 60), 64), ((60, 200), 64), ((60, 200), 16), ((8, 40), 8)])
def test_joins_near_the_bound(spark, sizes, small, monkeypatch):
    """Chains of edits around a similarity of 0.8, at sizes where bands meet, under both kinds of signatures."""
    monkeypatch.setattr(J, "COMMON", 3)
    monkeypatch.setattr(J, "SMALL", small)
    r, rows = random.Random(str(sizes)), []
    for g in range(14):
        words = [f"g{g}w{r.randrange(10**6)}" for _ in range(r.randint(*sizes))]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            cut = words if r.random() < 0.5 else words[: max(1, len(words) - r.randint(0, 4))]
            words = edited(cut, r, r.choice([0.005, 0.02, 0.03]))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert _got(d) == sorted(map(str, brute(rows)))


def test_shared_passages_and_hot_groups(spark):
    """A passage in many unrelated documents links none of them; a large group of near copies is one component."""
    r, rows = random.Random(9), []
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(120):
        own = " ".join(f"d{i}x{j}" for j in range(r.randint(20, 200)))
        rows.append((i, passage + " " + own if i % 2 else own + " " + passage))
    base = [f"n{j}" for j in range(150)]
    rows += [(1000 + i, " ".join(edited(base, r, 0.005))) for i in range(80)] + [(2000 + i, " ".join(base)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert _got(d) == sorted(map(str, brute(rows)))


def _passage_in_all(n, r):
    """Unrelated documents that share a passage, chains of near copies among them that share it too."""
    rows, passage = [], [f"p{i}" for i in range(60)]
    for i in range(n):
        own = [f"d{i}x{j}" for j in range(r.randint(150, 300))]
        rows.append((i, " ".join(passage + own if i % 2 else own + passage)))
        if i % 10 == 0:
            for k in range(3):
                own = edited(own, r, 0.01)
                rows.append((n + 3 * i + k, " ".join(passage + own)))
    return rows


@pytest.mark.parametrize("block", [64])
def test_large_clusters_sign_anew(spark, block, monkeypatch):
    """Nothing is known as common beforehand, so all that share the passage are one cluster; its work stays linear and no link is lost."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCKS", 1)
    monkeypatch.setattr(J, "common_shingles", lambda docs, width: np.zeros(0, np.uint64))
    work, compared = [], J._compared

    def counting(under, sizes, *rest):
        work.append([r["k"] for r in sizes.collect()])
        return compared(under, sizes, *rest)

    monkeypatch.setattr(J, "_compared", counting)
    rows = _passage_in_all(500, random.Random(3))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert _got(d) == sorted(map(str, brute(rows)))
    # clusters of a block at most are compared whole; of the large one next to nothing is left to compare
    assert len(work) == 2 and max(work[0]) <= block and sum(k * k for k in work[1]) < len(rows)


def test_spread_join_is_an_inner_join(spark):
    r = random.Random(1)
    big = [(0 if r.random() < 0.4 else r.randrange(300), i) for i in range(4000)] + [(None, 1)]
    small = [(k, f"s{k}") for k in range(0, 250)] + [(7, "again")]
    b, s = spark.createDataFrame(big, "k bigint, v bigint"), spark.createDataFrame(small, "k bigint, w string")
    got = sorted(tuple(x) for x in spread_join(b, s, "k", F.col("v"), hot_keys(b.select("k"), rows=50)).select("k", "v", "w").collect())
    assert got == sorted((k, v, w) for k, v in big for j, w in small if k == j)
    assert spread_join(b.limit(0), s, "k", F.col("v"), hot_keys(b.limit(0).select("k"))).count() == 0


def test_id_filter_holds_for_every_id(spark):
    ids, other = spark.range(0, 30_000, 3), spark.range(1, 30_000, 3)
    for most, share in ((1 << 27, 0.02), (1 << 12, 1.01)):
        maybe = id_filter(ids, most)(F.col("id"))
        assert ids.where(maybe).count() == 10_000 and other.where(maybe).count() <= share * 10_000
    assert ids.where(id_filter(ids.limit(0))(F.col("id"))).count() == 0


def test_signatures_meet_for_every_similar_pair():
    """The guarantee itself: any pair at or above the bound shares a signature, whatever counts as common."""
    r = np.random.default_rng(4)
    bands, met = J.Bands(), 0
    for _ in range(1500):
        n = int(r.integers(4, 400))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = int(r.integers(0, n // 5 + 2)), int(r.integers(0, n // 5 + 2))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if not len(b) or len(a) == len(b) == same or 100 * same < 80 * (len(a) + len(b) - same):
            continue
        common = np.sort(r.permutation(a)[: int(r.integers(0, n))])
        met += 1
        assert len(np.intersect1d(J.signatures(a, bands, common), J.signatures(b, bands, common)))
    assert met > 300


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and len(got) == 101
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# embeddings ----------------------------------------------------------------------


def test_decoder_finds_the_nearest_lattice_point():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    near = L.decode(x)
    d = ((x - near) ** 2).sum(1)
    for v in L.ROOTS:  # no neighbour is nearer, and a nearest point has no nearer neighbour
        assert (d <= ((x - near - v) ** 2).sum(1) + 1e-9).all()
    assert ((near * 2 == np.rint(near * 2)).all()) and (np.rint(near.sum(1)) % 2 == 0).all() and len(L.ROOTS) == 240
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1


def test_cells_do_not_depend_on_company():
    u = L.units(np.random.default_rng(2).normal(size=(300, 64)).astype(np.float32))
    whole = L.cells(u, 2, 3)
    assert (np.concatenate([L.cells(u[i : i + 7], 2, 3) for i in range(0, 300, 7)]) == whole).all()


def _brute_links(v, bound=0.95):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return (u @ u.T) >= bound


def test_links_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)  # so that hot cells are split
    r = np.random.default_rng(3)
    v = [r.normal(size=64) for _ in range(150)]
    for size in (2, 5, 200):
        c = r.normal(size=64)
        v += [c + r.normal(size=64) * 0.12 for _ in range(size)]
    v += [v[0]] * 90
    v = np.array(v, np.float32)
    want = _brute_links(v.astype(float))
    d = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, n_links int")
    got = L.near_duplicates(d).toPandas().sort_values("vec_id")
    assert len(got) == len(v)
    degree = want.sum(1) - 1
    assert (got["n_links"].to_numpy() <= degree).all() and got["n_links"].sum() >= 0.995 * degree.sum()
    assert (got["component_id"].to_numpy()[150:] <= got["vec_id"].to_numpy()[150:]).all()
    assert got["component_id"].nunique() == 150 + 3 and (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [float("nan"), 2.0, 3.0, 4.0]), (8, [float("inf"), 2.0, 3.0, 4.0]), (9, [*one, 5.0]), (None, one), (10, one), (10, one)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in L.near_duplicates(d).collect())
    assert got == sorted([("1", 4, 1, True), ("2", 4, 1, False), ("10", 4, 1, False), ("10", 4, 1, False), ("None", 4, 1, False), *((str(i), 0, i, True) for i in range(3, 10))])
    alone = spark.createDataFrame([(None, one), (None, [4.0, 1.0, 0.0, 0.0]), (None, [4.0, 1.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in L.near_duplicates(alone).collect()) == [(0, None, True), (1, None, False), (1, None, False)]
    assert L.near_duplicates(d.limit(0)).count() == 0


def _components(links):
    """Smallest member of each row's component."""
    low = np.arange(len(links))
    while True:
        new = np.where(links, low[None, :], len(low)).min(1)
        if (new == low).all():
            return low
        low = new


def test_every_row_against_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = L.op6_lattice_dedup(spark, sf).toPandas().sort_values("vec_id")
    rows = table(spark, sf, "embeddings").orderBy("vec_id").toPandas()
    links = _brute_links(np.stack(rows["embedding"].to_numpy()).astype(float))
    degree = links.sum(1) - 1
    assert (got["n_links"].to_numpy() <= degree).all() and got["n_links"].sum() >= 0.99 * degree.sum()
    want = rows["vec_id"].to_numpy()[_components(links)]
    assert (got["component_id"].to_numpy() == want).mean() >= 0.99 and (got["kept"] == (got["vec_id"] == got["component_id"])).all()


@pytest.mark.parametrize("n", [1_000, 100_000, 10_000_000, 1_000_000_000])
def test_settings_find_pairs_at_the_bound_and_keep_strangers_apart(n):
    """Recall at cosine 0.95 measured anew, with real projections; strangers that a vector meets in a table."""
    blocks, tables = L.settings(n)
    r = np.random.default_rng(n)
    u = L.units(r.normal(size=(400, 64)))
    side = r.normal(size=u.shape)
    side = L.units(side - (side * u).sum(1, keepdims=True) * u)
    v = 0.95 * u + np.sqrt(1 - 0.95**2) * side
    a, b = L.cells(u, blocks, tables), L.cells(v, blocks, tables)
    found = (a == b[:, :, :1]).any((1, 2)) | (b == a[:, :, :1]).any((1, 2))
    assert found.mean() >= 0.95
    if n <= 100_000:
        x = L.cells(L.units(r.normal(size=(4000, 64))), blocks, 1)[:, 0]
        _, times = np.unique(x[:, 0], return_counts=True)
        met = (times * (times - 1.0)).sum() / 4000**2 * n * (1 + 2 * L.PROBES)
        assert met <= 4 * L.MEET


@pytest.mark.parametrize("name", ["op6_lattice_dedup", "op8_ngram_jaccard_join"])
def test_queries_agree_with_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, sf).toPandas()
    key = want.columns[0]
    want, got = want.sort_values(key).reset_index(drop=True), got.sort_values(key).reset_index(drop=True)
    assert (want == got[want.columns]).all().all() and (want.dtypes == got[want.columns].dtypes).all()
