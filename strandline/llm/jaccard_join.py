"""N-gram Jaccard join by universe partition and pigeonhole, exact on shingle sets.

Two sets of sizes l <= m that are similar differ in at most (l + m) / 9 shingles
(for 0.8), and in at most H(l) whatever the partner. Sizes are cut into bands; a
set signs in its own band and in the next ones that a partner may be in. Within a
band the universe of shingle hashes is divided into segments:

* Large bands: about a third as many segments as the band's largest size. A set
  signs its first H(l) + 1 segments that hold something and are not costly, each
  by a hash of the segment's subset. A similar pair has an equal one among them:
  of the shorter of the two stretches, its owner signs H(l) + 1 segments and at
  most H(l) of these differ. A segment is costly if all it holds are common
  shingles; whether it is depends on its content alone, so both sets agree. That is
  the allocation by cost: common content is skipped and paid for by further segments.
* Small bands, and sets that run out of segments: H/2 + 1 segments, of which one
  differs by at most one shingle. Signed are each segment's subset and its
  one-deletion neighbourhood. Of a pair of which one has enough segments above,
  that one's stretch is the shorter, so this serves pairs of two such sets only.

Common shingles are estimated on every fourth document (``SHARE``): those in ``COMMON``
of these, or in one of ``RARE`` where that is more, so that they are at most ``RARE``
times the mean size of a set. The estimate steers cost only, never what is found:
any choice gives all links.

Equal sets are one class from the start, named by a fingerprint whose low bits tell
the size to one per cent. Copies thus cost one signature set per task and are never
expanded. Signatures travel in arrays, many to a row, dealt by hash ranges to
buckets. A bucket emits the lists of classes under one signature. Each list has a hub,
the class that shares most signatures with others (the text that near copies stem
from), which is paired with the rest. These pairs are verified in two steps: on the
quarter of the universe with the smallest hashes, where a pair that already differs
too much ends, then on whole sets. Components are formed. What lists still hold
apart is compared in clusters, all such lists of a hub together: each set travels
once for its cluster, not once for each pair, and a block of sets is compared by one
product of matrices; only links leave the cluster. Pairs inside one component need
no check for the components to be exact. A cluster of more than ``BLOCKS`` blocks signs
anew, with what is common inside the cluster skipped: all its sets agree on that, so
its similar pairs still meet, and unrelated texts that merely share a passage do not.

Texts are found by ids behind a Bloom filter, and joins on classes and hubs deal hot
keys to many tasks, at every size in the same way.

Defined cases: A-Z are lower-cased; null and empty text has no shingles and links
with nothing; repeated rows are copies of each other; null doc_ids join components
but never name them (a component of only such is null); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.joins import hot_keys, id_filter, spread_join
from strandline.llm.shingles import mix, shingle_sets
from strandline.runtime import durable, ship, shuffle_partitions, table, tidy

WIDTH = 5
NUM, DEN = 80, 100
#: Up to this size, bands grow by the similarity and sign one-deletion neighbourhoods; above, they double.
SMALL = 64
#: One of so many documents tells common shingles; a shingle in so many of these, and in one of so many, is common.
SHARE, COMMON, RARE = 4, 4, 32_000
#: Sets of a large cluster, about, that tell what is common inside it.
GUIDES = 64
#: Signatures that a task gathers before it sends them, and buckets for each shuffle partition.
FLUSH, BUCKETS_EACH = 1_000_000, 8
#: Sets of a cluster that are compared at a time.
BLOCK = 768
#: Blocks of a cluster up to which all pairs of them are compared: each set travels so many times at most.
BLOCKS = 8


class Bands:
    """The size bands and what holds in each, for the similarity num/den."""

    def __init__(self, num: int = NUM, den: int = DEN, small: int = SMALL):
        self.num, self.den, self.small = num, den, small
        self.low, at = [1], 1
        while at < 1 << 40:
            at = max(at + 1, at * den // num + 1) if at < small else at * 2
            self.low.append(at)
        self.low = np.array(self.low, np.int64)

    def differ(self, l: np.ndarray | int):
        """H(l): shingles in which a set of size l and a similar one that is as large or larger differ at most."""
        return (self.den - self.num) * (l + l * self.den // self.num) // (self.den + self.num)

    def top(self, band: int) -> int:
        return int(self.low[band + 1]) - 1

    def between(self, band: int) -> int:
        """Shingles in which two similar sets of the band differ at most."""
        return (self.den - self.num) * 2 * self.top(band) // (self.den + self.num)

    def of(self, l: int) -> range:
        """Bands in which a set of size l signs."""
        b = int(np.searchsorted(self.low, l, side="right")) - 1
        return range(b, int(np.searchsorted(self.low, l * self.den // self.num, side="right")))


def _segments(u: np.ndarray, m: int) -> np.ndarray:
    return ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def _sign(band: int, kind: int, m: int, seg: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(content ^ mix((seg << np.uint64(16)) + np.uint64(band << 1 | kind) + (np.uint64(m) << np.uint64(48))))


def signatures(u: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """All signatures of a sorted set."""
    l, out = len(u), []
    if not bands.differ(l):
        return np.zeros(0, np.uint64)  # only equal sets are similar, and those are one class
    v = mix(u ^ np.uint64(0x5851F42D4C957F2D))
    usual = np.zeros(l, bool)
    if len(common):
        usual = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
    need = bands.differ(l) + 1
    for b in bands.of(l):
        h = bands.between(b)
        if bands.top(b) > bands.small:
            m = bands.top(b) // 3 + 2
            seg = _segments(u, m)
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            costly = np.logical_and.reduceat(usual, first)
            kept = np.flatnonzero(~costly)
            enough = len(kept) >= need
            kept = kept[:need]
            out.append(_sign(b, 0, m, seg[first[kept]], np.add.reduceat(v, first)[kept]))
            if enough:
                continue
        m = h // 2 + 1
        seg = _segments(u, m)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg.astype(np.int64), v)
        out += [_sign(b, 1, m, np.arange(m, dtype=np.uint64), sums), _sign(b, 1, m, seg, sums[seg.astype(np.int64)] - v)]
    return np.concatenate(out)


#: Low bits of a fingerprint that hold the size, in steps of one per cent.
SIZE_BITS = 12


def fingerprint(u: np.ndarray) -> int:
    """A signed 64-bit number for the set, the same for equal sets; the low bits order sets by size."""
    x = int(mix(np.array([int(mix(u).sum(dtype=np.uint64)) + len(u) * 0x9E3779B9 & (1 << 64) - 1], np.uint64)).view(np.int64)[0])
    return x >> SIZE_BITS << SIZE_BITS | int(math.log(len(u)) / math.log(1.01))


def size_reach(num: int, den: int) -> int:
    """Steps of size that two similar sets are apart at most."""
    return math.ceil(math.log(den / num) / math.log(1.01)) + 1


QUARTER, WHOLE = 1 << 62, 1 << 64
STAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
STAGE_SQL = "bucket int, kind int, a binary, b binary, c binary"


def _packed(s: np.ndarray, nodes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Signatures and their classes, a row for each bucket."""
    bucket = _segments(s, n_buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    s, nodes, bucket = s[order], nodes[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
    rows = [(int(bucket[a]), 1, s[a:z].tobytes(), nodes[a:z].tobytes(), None) for a, z in zip(cut, cut[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), STAGE, strict=True)], schema=STAGE)


def _emit(batches: Iterator[pa.RecordBatch], width: int, bands: Bands, common: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: doc_ids, fingerprints, set sizes of many documents; kind 1: signatures of one bucket with their classes."""
    sigs, nodes, seen, held = [], [], set(), 0

    turn = 0
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        for sets in shingle_sets(batch.column(1), width):
            fps = np.array([fingerprint(u) if len(u) else 0 for u in sets], np.int64)
            sizes = np.array([len(u) for u in sets], np.int64)
            which = slice(at, at + len(sets))
            at += len(sets)
            turn = (turn * 31 + int(fps.sum() & 0xFFFF) + 1) % n_buckets
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((turn, 0, ids[which].tobytes() + known[which].tobytes(), fps.tobytes(), sizes.tobytes()), STAGE, strict=True)], schema=STAGE)
            for u, fp in zip(sets, fps.tolist(), strict=True):
                if len(u) and fp not in seen:
                    seen.add(fp)
                    s = signatures(u, bands, common)
                    sigs.append(s), nodes.append(np.full(len(s), fp, np.int64))
                    held += len(s)
            if held >= FLUSH:
                yield _packed(np.concatenate(sigs), np.concatenate(nodes), n_buckets)
                sigs, nodes, seen, held = [], [], set(), 0
    if held:
        yield _packed(np.concatenate(sigs), np.concatenate(nodes), n_buckets)


MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("list", pa.binary())])
MET_SQL = "kind int, a bigint, b bigint, n bigint, list binary"


def _meet(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: doc_id, fingerprint, set size; 1: two classes alone under a signature that may be similar; 2: list hash and the classes under one signature."""
    bucket, sigs, nodes, low = None, [], [], (1 << SIZE_BITS) - 1

    def out(kind, a, b, n, lists=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), a, pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(lists if lists is not None else [None] * len(b), pa.binary())], schema=MET)

    def close():
        s, n = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        same = s[1:] == s[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        s, n = s[shared], n[shared]
        if not len(s):
            return
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
        s, n = s[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(first, len(s)))
        two = first[size == 2]
        two = two[np.abs((n[two] & low) - (n[two + 1] & low)) <= reach]
        pairs = np.unique(np.stack([n[two], n[two + 1]], axis=1), axis=0)
        if len(pairs):
            yield out(1, pa.array(pairs[:, 0]), pairs[:, 1], np.zeros(len(pairs), np.int64))
        lists, told = [], set()
        for f, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            raw = n[f : f + k].tobytes()
            if raw not in told:
                told.add(raw)
                lists.append((int(mix(n[f : f + k].view(np.uint64)).sum(dtype=np.uint64).view(np.int64)), k, raw))
        if lists:
            h, k, raw = zip(*lists, strict=True)
            yield out(2, pa.array(h, pa.int64()), np.array(k), np.zeros(len(k), np.int64), list(raw))

    for batch in batches:
        for which, kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if kind == 0:
                fps = np.frombuffer(b, np.int64)
                ids, known = np.frombuffer(a[: 8 * len(fps)], np.int64), np.frombuffer(a[8 * len(fps) :], bool)
                yield out(0, pa.array(ids, mask=~known), fps, np.frombuffer(c, np.int64))
                continue
            if which != bucket and sigs:
                yield from close()
                sigs, nodes = [], []
            bucket = which
            sigs.append(np.frombuffer(a, np.uint64)), nodes.append(np.frombuffer(b, np.int64))
    if sigs:
        yield from close()


def common_shingles(docs: DataFrame, width: int, share: int = SHARE, common: int = COMMON) -> np.ndarray:
    """Sorted hashes of shingles that are common in one of ``share`` documents; a guide to cost only."""
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in shingle_sets(b.column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array([u.view(np.int64) for u in some], pa.list_(pa.int64()))], ["u"])

    bar = max(common, -(-some.count() // RARE))
    often = some.mapInArrow(sets, "u array<bigint>").select(F.explode("u").alias("u")).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= bar)
    return np.sort(often.select("u").toArrow().column("u").to_numpy().view(np.uint64))  # at most RARE times the mean size of a set


def candidates(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Durable rows of MET: documents with their classes, pairs to verify, lists of classes under one signature."""
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    sent = spark.sparkContext.broadcast(common_shingles(docs, width))
    n, reach = parts * BUCKETS_EACH, size_reach(bands.num, bands.den)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda b: tidy(_emit(b, width, bands, sent.value, n)), STAGE_SQL)
    return durable(rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda b: tidy(_meet(b, reach)), MET_SQL))


def _free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that only finished, checkpointed plans refer to, and give freed memory back."""
    list(tidy(()))
    spark.sparkContext._jvm.System.gc()


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: distinct, durable) whose sets are similar. ``reps``: fp and doc_id of one document of each class."""
    some = _compare(docs, reps, pairs, width, num, den, QUARTER)
    _free(docs.sparkSession)
    out = _compare(docs, reps, some, width, num, den, WHOLE)
    _free(docs.sparkSession)
    return out


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int, below: int) -> DataFrame:
    """fp, n, u (hashes under ``below``) of the wanted classes and a few others; a class comes more than once only where rows repeat a doc_id or have none."""
    ids = durable(reps.join(wanted, "fp", "left_semi").select("doc_id").where("doc_id is not null"))
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    some = some.where(F.col("doc_id").isNull() | id_filter(ids)(F.col("doc_id")))  # what it lets through besides meets no pair

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in shingle_sets(b.column(1), width):
                some = [u for u in some if len(u)]
                cut = [u if below == WHOLE else u[: np.searchsorted(u, np.uint64(below))] for u in some]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(u) for u in some], pa.int64()), pa.array([len(u) for u in some], pa.int64()), pa.array([u.tobytes() for u in cut], pa.binary())], ["fp", "n", "u"])

    return some.mapInArrow(lambda b: tidy(sets(b)), "fp bigint, n bigint, u binary")


def _compare(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, num: int, den: int, below: int) -> DataFrame:
    """Pairs that differ in no more shingles than similar sets may, counting hashes under ``below`` alone."""
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    found = _sets(docs, reps, wanted, width, below)
    side = lambda k: found.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("u").alias(f"u{k}"))
    hot = hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("fp")))  # of both, so that both joins read one shuffle of sets
    both = spread_join(spread_join(pairs, side("a"), "a", F.col("b"), hot), side("b"), "b", F.col("a"), hot).select("a", "b", "na", "nb", "ua", "ub")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for m, n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                apart = len(x) + len(y) - 2 * same
                # with all hashes, the same as den * |common| >= num * |either|
                ok.append(min(m, n) * den >= max(m, n) * num and apart * (den + num) <= (den - num) * (m + n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return durable(both.mapInArrow(lambda b: tidy(check(b)), "a bigint, b bigint").distinct())


def with_hubs(lists: DataFrame) -> DataFrame:
    """``lists`` (a, n, node) with hub: the class of the list that is in most and largest lists."""
    weights = lists.groupBy("node").agg(F.sum("n").alias("w"))
    top = lists.join(weights, "node").groupBy("a").agg(F.max(F.struct("w", "node"))["node"].alias("hub"))
    return lists.join(top, "a").select("hub", "node", "a")


def hub_pairs(under: DataFrame, reach: int) -> DataFrame:
    """Pairs of each hub with the classes of its lists that may be similar by size."""
    size = lambda c: F.col(c).bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("bigint"))
    met = under.where((F.col("node") != F.col("hub")) & (F.abs(size("node") - size("hub")) <= reach))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _open(under: DataFrame) -> DataFrame:
    """hub and k (its classes) of clusters in which more than one component is left. ``under``: hub, node, c."""
    return under.groupBy("hub").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("hub", "k")


def _compared(under: DataFrame, sizes: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside clusters (hub, node, c; ``sizes``: hub, k), by pairs of blocks of sets (``found``)."""
    d = under.join(sizes.select("hub", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "hub")
    d = d.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("hub", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "c")
    d = d.join(found.withColumnRenamed("fp", "node"), "node").repartition(shuffle_partitions(under.sparkSession), "hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "node")
    return d.select("hub", "lo", "hi", "side", "node", "c", "n", "u").mapInArrow(lambda b: tidy(_clusters(b, num, den)), "a bigint, b bigint").distinct()


def cluster_links(docs: DataFrame, reps: DataFrame, under: DataFrame, comp: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between classes under one hub (hub, node) that are not in one component."""
    c = comp.withColumnRenamed("component", "c")
    under = durable(under.join(c, "node", "left").select("hub", "node", F.coalesce("c", "node").alias("c")))
    sizes = durable(_open(under))
    wanted = under.join(sizes, "hub", "left_semi").select(F.col("node").alias("fp")).distinct()
    found = _sets(docs, reps, wanted, width, WHOLE)
    links = _compared(under, sizes.where(F.col("k") <= BLOCK * BLOCKS), found, num, den)
    large = sizes.where(F.col("k") > BLOCK * BLOCKS)
    if not large.limit(1).count():
        return links
    met = _signed_anew(under, large, found, Bands(num, den))
    lists = with_hubs(_unpack_lists(met.where("kind = 2").select("a", "list").dropDuplicates(["a"]))).select("hub", "node").distinct()
    lists = durable(lists.join(c, "node", "left").select("hub", "node", F.coalesce("c", "node").alias("c")))
    some = _compare(docs, reps, durable(met.where("kind = 1").select("a", "b").distinct()), width, num, den, WHOLE)
    return links.unionByName(some).unionByName(_compared(lists, _open(lists), found, num, den)).distinct()


def _signed_anew(under: DataFrame, large: DataFrame, found: DataFrame, bands: Bands) -> DataFrame:
    """Durable rows of MET for clusters that sign with what is common among about ``GUIDES`` of their sets skipped."""
    spark = under.sparkSession
    parts, reach = shuffle_partitions(spark), size_reach(bands.num, bands.den)
    n = parts * BUCKETS_EACH
    members = under.join(F.broadcast(large), "hub").select("hub", "k", F.col("node").alias("fp"))  # of more than BLOCK * BLOCKS classes each
    members = durable(members.join(found.dropDuplicates(["fp"]), "fp").select("hub", "k", "fp", "u"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(u.as_buffer(), np.int64) for u in b.column(1)], pa.list_(pa.int64()))], ["hub", "us"])

    guides = members.where(F.pmod(F.xxhash64("fp"), F.col("k")) < GUIDES).select("hub", "u").mapInArrow(numbers, "hub bigint, us array<bigint>")
    often = guides.select("hub", F.explode("us").alias("x")).groupBy("hub", "x").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    common = members.select("hub").distinct().join(often.groupBy("hub").agg(F.sort_array(F.collect_list("x")).alias("common")), "hub", "left")  # of about GUIDES sets
    common = common.select("hub", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    signing = spread_join(members.select("hub", "fp", "u"), common, "hub", F.col("fp"), hot_keys(members.select("hub")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hub, fp, u, often in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                s = signatures(np.frombuffer(u.as_buffer(), np.uint64), bands, np.sort(often.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                s = mix(s ^ mix(np.array([hub], np.int64).view(np.uint64)))  # clusters keep to themselves
                if len(s):
                    yield _packed(s, np.full(len(s), fp, np.int64), n)

    rows = signing.select("hub", "fp", "u", "common").mapInArrow(lambda b: tidy(sign(b)), STAGE_SQL)
    return durable(rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda b: tidy(_meet(b, reach)), MET_SQL))


def _clusters(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    key, rows = None, {}

    def close():
        side, node, c, n, u = (list(x) for x in zip(*rows.values(), strict=True))
        if len(set(c)) < 2:
            return
        side, node, c, n, size = np.array(side), np.array(node), np.array(c), np.array(n), np.array([len(x) for x in u])
        _, col, times = np.unique(np.concatenate(u), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(u)), size)
        name = np.cumsum(times > 1) - 1  # a column for each shingle that two sets have
        shared = times[col] > 1
        row, col, width = row[shared], name[col[shared]], int((times > 1).sum())
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(u), len(u)), np.float32)  # counts stay whole numbers below 2**24
        for lo in range(0, width, 2048):
            a, z = np.searchsorted(col, [lo, lo + 2048])
            m = np.zeros((len(u), min(2048, width - lo)), np.float32)
            m[row[a:z], col[a:z] - lo] = 1
            common += m @ m.T
        apart = size[:, None] + size[None, :] - 2 * common
        ok = np.triu(apart * (den + num) <= (den - num) * (n[:, None] + n[None, :]), 1) & (c[:, None] != c[None, :])
        ok &= np.minimum(n[:, None], n[None, :]) * den >= np.maximum(n[:, None], n[None, :]) * num
        if key[1] != key[2]:
            ok &= side[:, None] != side[None, :]
        i, j = np.nonzero(ok)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    for b in batches:
        for hub, lo, hi, side, node, c, n, u in zip(*(b.column(k).to_pylist() for k in range(7)), b.column(7), strict=True):
            if (hub, lo, hi) != key:
                if len(rows) > 1:
                    yield from close()
                key, rows = (hub, lo, hi), {}
            rows[node] = (side, node, c, n, np.frombuffer(u.as_buffer(), np.uint64))  # a class once, however often its row comes
    if len(rows) > 1:
        yield from close()


def similar_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, fp, n_shingles, component_id for every row of ``docs``."""
    met = candidates(docs, width, Bands(num, den))
    classes = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), F.col("n").alias("n_shingles"))
    reps = durable(classes.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    under = with_hubs(_unpack_lists(met.where("kind = 2").select("a", "list").dropDuplicates(["a"])))
    under = durable(under.select("hub", "node").distinct())
    pairs = durable(met.where("kind = 1").select("a", "b").unionByName(hub_pairs(under, size_reach(num, den))).distinct())
    _free(docs.sparkSession)
    links = verify(docs, reps, pairs, width, num, den)
    comp = components(links, "a", "b")
    more = durable(cluster_links(docs, reps, under, comp, width, num, den))
    _free(docs.sparkSession)
    if more.limit(1).count():
        comp = components(links.unionByName(more), "a", "b")
    # the smallest doc_id of each class, then of each component
    least = reps.withColumnRenamed("doc_id", "least")
    groups = comp.select(F.col("node").alias("fp"), "component").join(least, "fp")
    groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("first")), "component").select("fp", "first")
    named = least.join(groups, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("first", "least").alias("component_id"))
    full = classes.where("n_shingles > 0").withColumn("_row", F.monotonically_increasing_id())  # of a durable table
    full = spread_join(full, named.withColumnRenamed("_fp", "fp"), "fp", F.col("_row"), hot_keys(full.select("fp")))
    none = classes.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return full.select("doc_id", "fp", "n_shingles", "component_id").unionByName(none)


def _unpack_lists(lists: DataFrame) -> DataFrame:
    """a (list), n (its classes), node: a row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)], pa.list_(pa.int64()))], ["a", "nodes"])

    return lists.mapInArrow(run, "a bigint, nodes array<bigint>").select("a", F.size("nodes").cast("bigint").alias("n"), F.explode("nodes").alias("node"))


def keep_one(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps one: that of the smallest doc_id.

    Documents without shingles stay, and so do those without doc_id. Of rows that
    repeat doc_id and text one stays. A filter of the ids in question tells which rows
    stay as they are; only what it lets through meets the ids in a shuffled join."""
    found = durable(similar_components(docs, width, num, den).where("n_shingles > 0 and doc_id is not null"))
    state = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("doc_id") != F.col("component_id")).alias("_goes"), F.count("*").alias("_times"))
    asked = durable(state.where("_goes or _times > 1"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").cast("bigint").alias("_doc"), "text")
    maybe = id_filter(asked.select("_id"))(F.col("_doc"))
    checked = rows.where(maybe).join(asked.hint("merge"), F.col("_doc") == F.col("_id"), "left").where("_goes is null or not _goes")
    once = checked.where("_times > 1").dropDuplicates(["_doc", "text"])
    kept = rows.where(~maybe).select("_row").unionByName(checked.where("_times is null").select("_row")).unionByName(once.select("_row"))
    return kept.select("_row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Every pair that shares a shingle, counted; components by all that a document reaches. For small tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
