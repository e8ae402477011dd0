from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing, token_files
from strandline.llm.tokens import WordTokens, default_path


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_parts_give_the_ids_of_the_whole_text(plain):
    tok, r = WordTokens(default_path()), random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", "a", "Zed", "é", "ß", "×", "12", "'", "'s", ".", "!!", "\t", "\r\n", "\u00a0", "\u3000", "\u180e", "中", "д", "<|endoftext|>", "|", "_", "²", "word", "\x1c", "\x85", "\U0001f600"]
    for _ in range(4000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(tok.encode(x), "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids, repr(x)


def test_plans_use_every_item_once_and_never_more_bins_than_best_fit():
    r = random.Random(2)
    for _ in range(150):
        cap = r.choice([10, 20, 50, 100])
        hist = {r.randint(1, cap): r.randint(1, 6) for _ in range(r.randint(1, 10))}
        plan, first = packing.bin_completion(hist, cap), packing.best_fit(hist, cap)
        for p in (plan, first):
            got = Counter()
            for items, n in p:
                assert sum(items) <= cap
                for s in items:
                    got[s] += n
            assert got == Counter(hist)
        assert packing.lower_bound(hist, cap) <= sum(n for _, n in plan) <= sum(n for _, n in first)


def _least_bins(items, cap):
    """Exact, by trying every bin for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - items[k]])
        place(k + 1, [*rooms, cap - items[k]])

    place(0, [])
    return best[0]


def test_small_cases_are_optimal_or_one_above():
    r, exact = random.Random(3), 0
    for _ in range(40):
        items = [r.randint(2, 12) for _ in range(r.randint(3, 9))]
        n = sum(k for _, k in packing.bin_completion(Counter(items), 15))
        best = _least_bins(items, 15)
        assert best <= n <= best + 1
        exact += n == best
    assert exact >= 38


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_search_beats_best_fit_where_many_pieces_share_a_sequence(seed):
    r = random.Random(seed)
    hist = Counter(r.randint(90, 160) for _ in range(4000))
    n, first = (sum(k for _, k in f(hist, 1024)) for f in (packing.bin_completion, packing.best_fit))
    assert n <= packing.lower_bound(hist, 1024) + 1 and first - n >= 10
    hist = Counter(r.randint(20, 100) for _ in range(50_000))
    assert sum(k for _, k in packing.bin_completion(hist, 1024)) == packing.lower_bound(hist, 1024)
    assert sum(k for _, k in packing.bin_completion({100: 1000}, 1024)) == 100


def _all_fillings(sizes, room):
    """Every multiset of ``sizes`` (with repeats) that fits, by trying them all."""
    out, items = set(), sorted(sizes, reverse=True)
    for mask in range(1 << len(items)):
        f = tuple(items[i] for i in range(len(items)) if mask >> i & 1)
        if sum(f) <= room:
            out.add(f)
    return out


def _subsets(f):
    return [tuple(f[i] for i in range(len(f)) if mask >> i & 1) for mask in range(1, 1 << len(f))]


def test_fillings_are_all_the_undominated_ones():
    r = random.Random(8)
    for plenty in (False, True):
        for _ in range(60):
            room, have = r.randint(5, 25), Counter(r.randint(1, 14) for _ in range(r.randint(1, 9)))
            got = [f for f in packing.fillings(have, room, room, plenty) if f is not None]
            assert len(got) == len(set(got)) and all(sum(f) <= room for f in got)
            if have[room]:
                assert got == [(room,)]
                continue
            want = set()
            for f in _all_fillings(list(have.elements()), room):
                left, free = room - sum(f), have - Counter(f)
                swaps = [(sum(s), len(s)) for s in _subsets(f)] + [(0, 0)]
                if not any(t <= x <= t + left and (x > t or n > 1) for x in free for t, n in swaps):
                    want.add(f)
            assert {tuple(sorted(f, reverse=True)) for f in got} == want
            assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_ranks_of_a_hot_length(spark, monkeypatch):
    """Many pieces of one length, also with null and repeated ids, and full pieces each get one place."""
    monkeypatch.setattr(packing, "RANK_ROWS", 16)
    rows = [(None if i % 5 == 0 else i // 3, 0, 0, 100 if i < 400 else 1 + i % 200, i) for i in range(900)] + [(9, 0, 0, 1024, 5)] * 30
    d = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(3)
    out = packing.pack(packing.durable(d)).toPandas()
    assert sorted(out["length"]) == sorted(x[3] for x in rows) and sorted(out["ids_crc32"]) == sorted(x[4] for x in rows)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    hist = Counter(x[3] for x in rows)
    assert out["sequence_id"].nunique() <= packing.lower_bound(hist, 1024) + 1


def test_packed_documents(awkward, empty, plain):
    rows = packing.pack_documents(awkward, with_ids=True).toPandas()
    texts = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert len(rows) == sum(-(-(len(plain.encode(t or "", add_special_tokens=False).ids) + 1) // 1024) for _, t in texts)
    for d, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = rows[rows["doc_id"].isna()] if d is None else rows[rows["doc_id"] == d]
        copies = sum(x == d for x, _ in texts)
        assert mine["length"].sum() == len(ids) * copies
        for p in mine.itertuples():
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.ids == part.tobytes()
            assert p.length == 1024 or p.piece == 0
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_token_files_round_trip(spark, awkward, empty, plain, tmp_path):
    token_files.write_token_files(awkward, f"file://{tmp_path}/t", file_tokens=500)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").toPandas().sort_values("start")
    want = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for r, (d, t) in zip(got.itertuples(), want, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert (r.doc_id != r.doc_id and d is None) or r.doc_id == d
        at += len(ids)
    token_files.write_token_files(empty, f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_any_token_without_block_decoding():
    r = np.random.default_rng(0)
    for top in (200, 50_257, 1 << 24, 1 << 31):
        for n in (1, 513, 3000):
            ids = (r.integers(0, top, n) >> r.integers(0, 12, n)).astype(np.uint32)
            f = token_files.TokenFile(token_files.encode_file([4, None], np.array([n // 2, n - n // 2]), ids))
            assert f.doc_ids == [4, None] and (f.tokens(0, n) == ids).all()
            for _ in range(20):
                a, b = sorted(r.integers(0, n + 1, 2))
                i = int(r.integers(0, n))
                assert (f.tokens(a, b) == ids[a:b]).all() and f.token(i) == ids[i]
            q = r.integers(0, n, 50)
            assert (f.at(q) == ids[q]).all()
