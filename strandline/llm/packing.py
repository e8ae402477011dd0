"""Best-fit packing of token sequences.

Lengths are all that packing needs, and there are at most ``capacity`` of them,
so the corpus is reduced to a histogram of lengths. Bin completion runs on that
histogram: a branch takes the largest length left, enumerates undominated
fillings around it, of any number of items, and applies one as often as the counts
allow; branches whose waste exceeds what a better solution may waste are pruned;
best-fit decreasing gives the incumbents. The plan (patterns and how often each is
used) grows with the number of distinct lengths, not of documents. Pieces then find
their place by their rank within their length: rank ranges of a length are dealt to
the slots of the patterns. Ranks are counted per (length, hash piece), and a length
has the more pieces the more rows it has, so a hot one is spread over many tasks.

Documents: ids of the text, then ``end_id``. Only longer ones than ``capacity``
are cut, into pieces of ``capacity``; the first piece may be shorter.

Defined cases: null and empty text is the end id alone; repeated rows are packed
once each; null doc_id is kept; an empty table gives an empty result; extra
columns are ignored; order among equal pieces does not matter.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.tokens import WordTokens, default_path
from strandline.runtime import durable, ship, table, tidy

CAPACITY = 1024
END_ID = 2
#: Ranks of a length are counted in pieces of about so many rows, and of more where there would be more than so many pieces in all.
RANK_ROWS, RANK_PIECES = 512, 16_384
#: Steps that the search may take after its first descent before it settles for its incumbent.
EFFORT = 5_000
SHIFT = 44  # bits of a rank


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_path()
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lambda batches: tidy(_cut(batches, path, capacity, end_id, with_ids)), schema)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tok = WordTokens.of(path)
    end = int(end_id).to_bytes(4, "little")
    for b in batches:
        rows, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, raw in enumerate(tok.encode_all(b.column(1))):
            raw += end
            n = len(raw) // 4
            first = (n - 1) % capacity + 1
            for k, at in enumerate([0, *range(first, n, capacity)]):
                size = capacity if k else first
                cut = raw[4 * at : 4 * (at + size)]
                rows.append(row), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(cut))
                if with_ids:
                    ids.append(cut)
        cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)


# the plan -------------------------------------------------------------------


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (items of a bin, number of such bins)."""
    rooms: list[int] = []  # sorted room values that open bins have
    bins: dict[int, list[list]] = {}
    for size in sorted((s for s, c in hist.items() if c), reverse=True):
        left = hist[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = bins[room][-1]
                m = min(left, group[1])
                group[1] -= m
                if not group[1]:
                    bins[room].pop()
                    if not bins[room]:
                        del bins[room], rooms[at]
                new = [(*group[0], size), m]
                left -= m
            else:
                each = capacity // size
                m = left // each or 1
                items = (size,) * min(each, left)
                new, left, room = [items, m], left - m * len(items), capacity - size * (len(items) - 1)
            room -= size
            if room not in bins:
                bins[room] = []
                bisect.insort(rooms, room)
            bins[room].append(new)
    return [(tuple(items), n) for groups in bins.values() for items, n in groups]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, with the large items that cannot share (Martello and Toth)."""
    sizes = np.array(sorted(s for s in hist if hist[s]), dtype=np.int64)
    if not len(sizes):
        return 0
    counts = np.array([hist[s] for s in sizes.tolist()], dtype=object)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in [0, *(s for s in sizes.tolist() if 2 * s <= capacity)]:
        alone = int(counts[sizes > capacity - k].sum())
        half = (sizes <= capacity - k) & (2 * sizes > capacity)
        n_half = int(counts[half].sum())
        small = (sizes >= k) & (2 * sizes <= capacity)
        spare = n_half * capacity - int((sizes[half] * counts[half]).sum())
        best = max(best, alone + n_half + max(0, -(-(int((sizes[small] * counts[small]).sum()) - spare) // capacity)))
    return best


def fillings(hist: dict[int, int], room: int, waste: int, plenty: bool = False) -> Iterator[tuple[int, ...] | None]:
    """Undominated ways to fill ``room`` that leave at most ``waste``, one after the other: least waste first, then large
    items first or, with ``plenty``, those of which most are left. None stands for a dominated one, so that the caller can count what was tried; with large items first the first is never dominated.

    Sums that the sizes from some place on can reach are the bits of a number, so the
    enumeration enters no branch that does not end in a filling, however many items that takes."""
    sizes = sorted((s for s, c in hist.items() if c and s <= room), key=(lambda s: (-hist[s], -s)) if plenty else (lambda s: -s))
    if hist.get(room, 0):
        yield (room,)  # one item that fills it dominates all else
        return
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, left, k = reach[-1], min(hist[s], room // s), 1
        while left:
            k = min(k, left)
            bits |= (bits << (k * s)) & mask
            left, k = left - k, 2 * k
        reach.append(bits)
    reach.reverse()  # reach[i]: sums of sizes[i:]

    def exact(total: int, at: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for i in range(at if plenty else bisect.bisect_left(sizes, -total, at, key=lambda s: -s), len(sizes)):
            if not reach[i] >> total & 1:
                return
            s = sizes[i]
            for k in range(min(hist[s], total // s), 0, -1):
                if reach[i + 1] >> (total - k * s) & 1:
                    for rest in exact(total - k * s, i + 1):
                        yield (s,) * k + rest

    for left in range(min(waste, room) + 1):
        if reach[0] >> (room - left) & 1:
            for chosen in exact(room - left, 0):
                yield None if _dominated(chosen, left, hist, sizes) else chosen


def _dominated(chosen: tuple[int, ...], left: int, hist: dict[int, int], sizes: list[int]) -> bool:
    """Whether an item left out fits beside the chosen ones, or could take the place of some and fill more, or as much as two or more."""
    one, two, free = 1, 0, 0  # bits: sums of any of the chosen, sums of two or more, sizes left out
    for s in chosen:
        two |= two << s | (one & ~1) << s
        one |= one << s
    for s in sizes:
        if hist[s] > chosen.count(s):
            free |= 1 << s
    wide, done = one << 1 if left else 0, 1
    while done < left:  # sums with 1 to ``left`` added
        step = min(done, left - done)
        wide |= wide << step
        done += step
    return bool((wide | two) & free)


def bin_completion(hist: dict[int, int], capacity: int, effort: int = EFFORT) -> list[tuple[tuple[int, ...], int]]:
    """Branch and bound over fillings of the largest item; its incumbents complete a branch by best fit.

    A branch uses a filling as often as the counts allow, and once; a state is entered
    once. From a node its first branch is followed down; the others wait and are taken in
    the order of how many such turns lead to them (limited discrepancy search). The first
    descent, large items first, always reaches its end; then descents that spend the most
    plentiful sizes first have their turn, which leaves mixed sizes to the end. After
    ``effort`` further steps the incumbent stands. Small cases are searched through before that."""
    best = best_fit(hist, capacity)
    need, have = lower_bound(hist, capacity), sum(n for _, n in best)
    start = {s: c for s, c in hist.items() if c}
    total = sum(s * c for s, c in start.items())
    seen: set[int] = set()  # hashes of states
    queue: list[tuple] = [(0, False, 0, None, 0, 0, 0), (0, True, 0, None, 0, 0, 0)]  # turns, plenty, order, branch, bins, waste, ways tried
    order, mark, steps, first = 0, total, 0, True

    def branches(rest, waste, plenty):
        top = max(rest)
        for w in fillings({**rest, top: rest[top] - 1}, capacity - top, (have - 1) * capacity - total - waste, plenty):
            items = (top, *(w or ()))
            most = min(rest[s] // items.count(s) for s in set(items))
            most = -(-most // 2) if plenty else most
            yield from [(items, most), (items, 1)][: 1 + (most > 1)] if w is not None else [None]

    while queue and have > need and steps < effort:
        turns, plenty, _, done, used, waste, tried = heapq.heappop(queue)
        rest, new = dict(start), True
        for items, m in _listed(done):
            _take(rest, items, m)
        while rest and new and waste <= (have - 1) * capacity - total:
            branch = None
            for branch in itertools.islice(branches(rest, waste, plenty), tried, None):
                tried += 1
                steps += not first
                if branch or steps >= effort:
                    break
            if not branch:
                break
            order += 1
            heapq.heappush(queue, (turns + 1, plenty, order, done, used, waste, tried))
            items, m = branch
            _take(rest, items, m)
            done, used, waste, tried = (done, items, m), used + m, waste + m * (capacity - sum(items)), 0
            state = hash(frozenset(rest.items()))
            new = state not in seen
            seen.add(state)
            volume = total - used * capacity + waste
            if first and volume <= mark // 2:
                mark = volume
                have, best = _better(best, have, rest, done, used, capacity)
        if new:  # the waste bound, or the end, closes this branch
            have, best = _better(best, have, rest, done, used, capacity)
        first = False
    return best


def _take(rest: dict[int, int], items: tuple[int, ...], m: int) -> None:
    for s in items:
        rest[s] -= m
        if not rest[s]:
            del rest[s]


def _better(best, have, rest, done, used, capacity):
    """The incumbent, or this branch completed by best fit if that has fewer bins."""
    tail = best_fit(rest, capacity)
    count = used + sum(n for _, n in tail)
    return (count, [*_listed(done), *tail]) if count < have else (have, best)


def _listed(done) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while done:
        done, items, m = done
        out.append((items, m))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), first sequence id and offset of each run of equal slots."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in plan:
        at = 0
        for s in items:
            rows.append(((s << SHIFT) + taken.get(s, 0), sequence, at))
            taken[s] = taken.get(s, 0) + n
            at += s
        sequence += n
    rows.sort()
    key, seq, off = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, seq, off


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (durable; with the columns of ``token_pieces``) with sequence_id and offset.

    A piece of ``capacity`` tokens is a sequence of its own, numbered below zero where it
    stands. The others are ranked within their length, in as many pieces as its count asks for."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    hist.pop(capacity, None)
    key, seq, off = slots(bin_completion(hist, capacity))
    each = max(RANK_ROWS, -(-sum(hist.values()) // RANK_PIECES))
    parts = F.lit(",".join(str(-(-hist.get(n, 1) // each)) for n in range(capacity)))  # by length
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    dealt = pieces.where(F.col("length") < capacity)
    many = F.element_at(F.split(parts, ",").cast("array<bigint>"), (F.col("length") + 1).cast("int"))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many).cast("int"))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))  # at most capacity + RANK_PIECES rows
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(F.broadcast(base), (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select(*pieces.columns, (F.shiftleft(F.col("length"), SHIFT) + F.col("_base") + F.col("_rank")).alias("_key"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, want, side="right") - 1
            cols = [*b.columns[:-1], pa.array(seq[i] + (want - key[i])), pa.array(off[i])]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sequence_id", "offset"])

    return full.unionByName(ranked.mapInArrow(place, schema))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(durable(token_pieces(docs, capacity, end_id, tokenizer, with_ids)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
