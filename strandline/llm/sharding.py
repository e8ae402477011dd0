"""Sharding by minimax contiguous partition, with DataFrame functions only.

Rows with equal text are one atomic group. Groups stand in the order of a 64-bit
digest of the text, so equal texts are neighbours without a sort, and any
contiguous stretch of groups is a range of digests. The smallest capacity that
lets a greedy walk over the group sizes end within the wanted number of shards
is found by binary search; the walk's cuts are digests, so each row finds its
shard by comparing its digest with a few constants.

The search works on sums over 4096 digest ranges, which aggregate with map-side
combine. Where a cut could fall into a range for some capacity still possible,
that range alone is divided into 256 again, until what is left are single
digests. The driver thus holds a few thousand sums for each cut, whatever the
size of the input, and the result is the exact optimum.

Defined cases: null text counts as empty (size 1, crc32 of no bytes) and shares
the group of empty texts; an empty table gives an empty result; fewer groups than
shards leave shards empty; repeated rows are kept and get slots of their own;
extra columns are ignored. A group larger than the ideal shard stays whole, and
the capacity is then its size.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.runtime import durable, table

SHARDS = 8
#: Bits by which the whole, then an open range is divided.
FIRST, FAN = 12, 8
TOP = 1 << 64
#: Pieces in which the rows of a shard are numbered: for so many rows each, at least and at most so many.
PIECE_ROWS, PIECES = 50_000, (512, 4096)


def _walk(ends: list[int], sums: list[int], cap: int, shards: int) -> list[int] | None:
    """Greedy cuts (index after the last item of each shard but the last), or None if ``cap`` is too small."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        nxt = bisect_right(sums, done + cap)
        if nxt == len(ends):
            return cuts
        if nxt == at:
            return None
        cuts.append(nxt)
        at, done = nxt, sums[nxt - 1]
    return None


def _least(ends: list[int], sums: list[int], shards: int) -> int:
    """The smallest capacity for which the greedy walk ends."""
    lo, hi = 0, sums[-1] if sums else 0
    while lo < hi:
        mid = (lo + hi) // 2
        if _walk(ends, sums, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def cut_points(sized: DataFrame, shards: int = SHARDS) -> list[int]:
    """Digests (as unsigned numbers) at which a new shard begins. ``sized`` has key (bigint) and size."""
    leaves = _sums(sized, 64 - FIRST)
    while leaves:
        items = sorted(leaves)
        ends = [a + (1 << bits) for a, bits in items]
        sums = list(accumulate(leaves[i][0] for i in items))
        best = _least(ends, sums, shards)  # reached with the ranges as they are
        low = max([-(-sums[-1] // shards), *(size for size, single in leaves.values() if single)])
        # a greedy cut of any capacity from low to best lies from `behind` to `ahead`
        behind = ahead = 0
        open_ = set()
        for _ in range(shards - 1):
            first = bisect_right(sums, behind + low)
            last = min(bisect_right(sums, ahead + best), len(items) - 1)
            open_.update(i for i in items[first : last + 1] if not leaves[i][1])
            behind, ahead = (sums[first - 1] if first else 0), sums[last]
        if not open_:
            return [items[c][0] for c in _walk(ends, sums, best, shards)]
        for bits in {b for _, b in open_}:
            within = sized.where(F.shiftrightunsigned("key", bits).isin([a >> bits for a, b in open_ if b == bits]))
            leaves |= _sums(within, max(0, bits - FAN))
        for i in open_:
            del leaves[i]
    return []


def _sums(sized: DataFrame, left: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """(first digest, free bits) of each range -> total size, and whether one digest is all it holds."""
    part = F.shiftrightunsigned("key", left) if left else F.col("key")
    got = sized.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"))
    return {((int(r["part"]) << left) % TOP, left): (int(r["size"]), bool(r["single"])) for r in got.collect()}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = durable(docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    flip = 1 << 63  # unsigned order by signed comparison
    cuts = cut_points(sized.select("key", "size"), shards)
    place = F.col("key").bitwiseXOR(F.lit(-flip).cast("bigint"))
    at = F.lit(0)
    for c in cuts:
        at = at + (place >= F.lit(c - flip).cast("bigint")).cast("int")
    pieces = min(max(PIECES[0], sized.count() // PIECE_ROWS), PIECES[1])
    some = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))  # of a durable table
    placed = sized.withColumn("shard", at.cast("int")).withColumn("piece", F.pmod(some, F.lit(pieces)))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))  # at most shards * 4096 rows
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("_s"), F.col("piece").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    out = ranked.join(F.broadcast(offsets), (F.col("shard") == F.col("_s")) & (F.col("piece") == F.col("_p")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("bigint").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
