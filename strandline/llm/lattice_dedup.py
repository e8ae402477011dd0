"""Embedding near-dedup by lattice hashing: E8 cells of random projections, verified by cosine.

In each table a vector of length 1 is projected to Gaussian directions, eight for
each of ``blocks`` blocks, scaled by ``CELL``; each block is decoded to the nearest
point of the E8 lattice, and the points together are the cell. A vector is kept
under its cell and asks there and in the ``PROBES`` neighbouring cells (one step of
the 240 in one block) that are nearest to its projection. Vectors that meet in a cell
are compared by cosine in double precision, in blocks of rows.

``settings`` takes blocks and tables from the number of vectors: as many blocks as keep
the unrelated vectors that one meets in a table below ``MEET``, and then as many tables
as miss a pair at the very bound with a chance of ``MISS`` at most. Both chances come
from a trial with seeded Gaussian pairs. So work grows a little faster than the rows
(tables: power 0.1), not with their square.

Equal vectors are one class from the start and count as many times as they stand. Cells
are asked with ids alone; vectors travel only to cells where two classes meet. Pairs
are counted, not emitted: a pair counts where it meets first, by table and cell,
which follows from the two vectors alone; each cell gives per-class counts and a
spanning forest of its links. Cells with more than ``BLOCK`` classes are split into
pairs of blocks, each a unit of work of its own, so a common vector neither fills one
task nor is cut short.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do vectors of different dimension. Every row
is a vector of its own: rows that repeat a vec_id link like any others. A null vec_id
never names a component; one of only such has a null component_id, and the row is kept
if nothing else is in it. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.joins import hot_keys, spread_join
from strandline.llm.shingles import mix
from strandline.runtime import durable, ship, shuffle_partitions, table, tidy

COSINE = 0.95
PROBES, CELL = 4, 1.8
#: Unrelated vectors that one may meet in a table, about, and the chance to miss a pair at the bound.
MEET, MISS = 16, 0.002
BLOCK = 1024
#: Vectors whose cells are found at a time.
BATCH = 128


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with even sum (D8)."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: of D8 and D8 + 1/2, the nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray, table_: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table_ + 1, np.uint64)
    for k in range(points.shape[-1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(points[..., k] * 2).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _near(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """[n, blocks, 8] lattice points of projections, and [n, 1 + probes, blocks, 8] with the nearest neighbours in one block each."""
    n, blocks = x.shape[:2]
    own = decode(x.reshape(-1, 8)).reshape(x.shape)
    far = -((x - own).reshape(-1, 8) @ ROOTS.T).reshape(n, blocks * len(ROOTS))  # all roots have the same length
    out = np.repeat(own[:, None], 1 + probes, axis=1)
    for k in range(1, 1 + probes):
        at = far.argmin(1)
        far[np.arange(n), at] = np.inf
        out[np.arange(n), k, at // len(ROOTS)] += ROOTS[at % len(ROOTS)]
    return own, out


@functools.cache
def settings(n: int, cosine: float = COSINE, probes: int = PROBES, cell: float = CELL) -> tuple[int, int]:
    """(blocks, tables) for ``n`` vectors."""
    r = np.random.default_rng(5)
    for blocks in range(2, 9):
        x, z, w = (r.normal(size=(2000, blocks, 8)) for _ in range(3))
        (a, near_a), (b, near_b) = _near(x / cell, probes), _near((cosine * x + math.sqrt(1 - cosine**2) * z) / cell, probes)
        found = ((near_a == b[:, None]).all((2, 3)).any(1) | (near_b == a[:, None]).all((2, 3)).any(1)).mean()
        _, times = np.unique(decode(w.reshape(-1, 8)), axis=0, return_counts=True)
        alike = (times * (times - 1.0)).sum() / (times.sum() * (times.sum() - 1.0))  # two unrelated vectors, one block
        if n * alike**blocks * (1 + 2 * probes) <= MEET or blocks == 8:
            return blocks, max(1, math.ceil(math.log(MISS) / math.log(1 - min(max(found, 0.01), 0.999))))


def cells(unit: np.ndarray, blocks: int, tables: int, probes: int = PROBES, cell: float = CELL) -> np.ndarray:
    """[vector, table, 1 + probes] cell keys, the own cell first. The same for a vector in any company."""
    n = len(unit)
    rows = -(-len(unit) // BATCH) * BATCH  # products of one shape, so that a row's sums do not depend on how many there are
    unit = np.concatenate([unit, np.zeros((rows - len(unit), unit.shape[1]))]) if rows > len(unit) else unit
    out = np.empty((rows, tables, 1 + probes), np.int64)
    for t in range(tables):
        dirs = np.random.default_rng([unit.shape[1], t]).normal(size=(8 * blocks, unit.shape[1])).T / cell
        for lo in range(0, rows, BATCH):
            x = (unit[lo : lo + BATCH] @ dirs).reshape(BATCH, blocks, 8)
            out[lo : lo + BATCH, t] = _key(_near(x, probes)[1].reshape(BATCH, 1 + probes, -1), t)
    return out[:n]


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable() -> Column:
    """Whether ``embedding`` can link."""
    return F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _ask(batches: Iterator[pa.RecordBatch], *how) -> Iterator[pa.RecordBatch]:
    """cell, whether the class is kept there, class."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        lists = b.column(1)
        dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            raw = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for lo in range(0, len(at), 2048):
                c = cells(units(raw[lo : lo + 2048]), *how)
                n, tables, per = c.shape
                yield pa.RecordBatch.from_arrays([pa.array(c.reshape(-1)), pa.array(np.tile(np.arange(per) == 0, n * tables)), pa.array(np.repeat(ids[at[lo : lo + 2048]], tables * per))], ["cell", "own", "cid"])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked member to the first member of its component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


class _Seen:
    """Cells of vectors that were linked in this task, by vec_id."""

    def __init__(self, *how):
        self.how, self.at, self.known = how, {}, []

    def of(self, ids: np.ndarray, unit: np.ndarray) -> np.ndarray:
        new = [k for k, i in enumerate(ids.tolist()) if i not in self.at]
        if new:
            base = len(self.at)
            for n, k in enumerate(new):
                self.at[int(ids[k])] = base + n
            self.known.append(cells(unit[new], *self.how))
            self.known = [np.concatenate(self.known)]
        return self.known[0][[self.at[i] for i in ids.tolist()]]


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, *how) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and unit of work: (class, null, rows linked, counted here) and (class, class linked, 0)."""
    held: list[tuple] = []
    key, seen = None, _Seen(*how)

    def close():
        nonlocal seen
        if len(seen.at) > 50_000:
            seen = _Seen(*how)
        own = np.array([h[0] for h in held])
        if len(held) < 2 or not own.any():
            return
        ids, times, side = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
        by_len: dict[int, list[int]] = {}
        for k, h in enumerate(held):
            by_len.setdefault(len(h[4]), []).append(k)
        for some in by_len.values():
            at = np.array(some)
            unit = units(np.stack([np.asarray(held[k][4], np.float64) for k in some]))
            mine, i_, s_, m_ = own[at], ids[at], side[at], times[at]
            stay = np.flatnonzero(mine)
            found = []
            for lo in range(0, len(stay), 512):
                c = unit @ unit[stay[lo : lo + 512]].T
                a, b = np.nonzero(c >= cosine - 1e-9)
                found.append((a, stay[lo + b]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            # both kept here: once; within one block only in its own unit of work
            ok = (i_[a] != i_[b]) & (~mine[a] | (i_[a] < i_[b])) & ((s_[a] != s_[b]) | (key[1] == key[2]))
            a, b = a[ok], b[ok]
            exact = (unit[a] * unit[b]).sum(1) >= cosine
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y = back[: len(a)], back[len(a) :]
            first = _first_here(seen.of(i_[used], unit[used]), x, y, key[0])
            m = m_[used]
            counts = np.zeros(len(used), np.int64)
            np.add.at(counts, x[first], m[y[first]])
            np.add.at(counts, y[first], m[x[first]])
            p, q = _forest(x, y, len(used))
            name = i_[used]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([name, name[p]])), pa.array(np.concatenate([np.zeros(len(name), np.int64), name[q]]), mask=np.arange(len(name) + len(p)) < len(name)), pa.array(np.concatenate([counts, np.zeros(len(p), np.int64)]))], ["cid", "other", "n"])

    for b in batches:
        cell, lo, hi, own, cid, times, side = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        lists = b.column(7)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        for i, now in enumerate(zip(cell.tolist(), lo.tolist(), hi.tolist(), strict=True)):
            if now != key:
                if held:
                    yield from close()
                key, held = now, []
            held.append((own[i], cid[i], times[i], side[i], flat[ends[i] : ends[i + 1]]))
    if held:
        yield from close()


def _first_here(c: np.ndarray, x: np.ndarray, y: np.ndarray, cell: int) -> np.ndarray:
    """Whether each pair's first meeting (lowest table, then lowest cell key) is in ``cell``."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    done = np.zeros(len(x), bool)
    for t in range(c.shape[1]):
        at_y = (c[x, t] == c[y, t, :1]).any(1)  # x asks where y is kept
        at_x = (c[y, t] == c[x, t, :1]).any(1)
        here = np.minimum(np.where(at_y, c[y, t, 0], np.iinfo(np.int64).max), np.where(at_x, c[x, t, 0], np.iinfo(np.int64).max))
        best = np.where(~done & (at_x | at_y), here, best)
        done |= at_x | at_y
    return done & (best == cell)


def near_duplicates(df: DataFrame, cosine: float = COSINE, blocks: int | None = None, tables: int | None = None, probes: int = PROBES, cell: float = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``df``."""
    spark = df.sparkSession
    ship(spark)
    every = df.select("vec_id", "embedding")
    can = usable()
    classes = durable(every.where(can).groupBy("embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("least")))
    classes = classes.withColumn("cid", F.monotonically_increasing_id())  # of a durable table
    own = settings(1 << max(0, classes.count() - 1).bit_length(), cosine, probes, cell)
    how = (blocks or own[0], tables or own[1], probes, cell)
    asked = durable(classes.select("cid", "embedding").mapInArrow(lambda b: tidy(_ask(b, *how)), "cell bigint, own boolean, cid bigint"))
    sizes = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("pieces"))
    met = spread_join(asked, sizes, "cell", F.col("cid"), hot_keys(asked.select("cell"), rows=BLOCK))
    met = met.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("cell", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "own", "cid", "side")
    met = met.join(classes.select("cid", "times", "embedding"), "cid").select("cell", "lo", "hi", "own", "cid", "times", "side", "embedding")
    met = met.repartition(shuffle_partitions(spark), "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "cid")
    found = durable(met.mapInArrow(lambda b: tidy(_compare(b, cosine, *how)), "cid bigint, other bigint, n bigint"))
    links = found.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    comp = components(found.where("other is not null").select("cid", "other"), "cid", "other").withColumnRenamed("node", "cid")
    named = durable(classes.select("cid", "times", "least").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    first = named.groupBy("component").agg(F.min("least").alias("first"), F.sum("times").alias("all"))
    named = spread_join(named, first, "component", F.col("cid"), hot_keys(named.select("component"))).join(links, "cid", "left")
    named = named.join(classes.select("cid", F.xxhash64("embedding").alias("key"), F.col("embedding").alias("same")), "cid")
    named = named.select("key", "same", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("first").alias("component_id"), "all")
    rows = every.withColumn("row", F.monotonically_increasing_id()).where(can).withColumn("key", F.xxhash64("embedding"))
    linked = spread_join(rows, named, "key", F.col("row"), hot_keys(durable(rows.select("key")))).where(F.col("embedding") == F.col("same"))
    linked = linked.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("all") == 1).alias("kept"))
    alone = every.where(~can).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op6_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, for small tables of usable vectors with distinct ids.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id, least(v.vec_id, coalesce(low.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""
