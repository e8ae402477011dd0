"""Token-id files of directly addressable codes.

A file holds the ids of consecutive documents. Each id is split into chunks, low
bits first; level 0 has the first chunk of every id, level k the (k+1)-th chunk of
those ids that have one. Every level but the last carries a bitmap that says
whether an id goes on, with a directory of ranks every ``BLOCK`` bits. Token i is
read by its chunk of level 0 and, while the bitmap says so, by the chunk at the
bit's rank on the next level: no block is decoded. Chunks are whole
bytes; a file has as many levels as its largest id has bytes. A run of tokens is a
run on every level.

Files are kept as rows (one file each, as BINARY) in a table that Spark's writer
commits, so any store that Spark knows can hold them and lost tasks leave nothing
half written. Files are numbered in ascending doc_id order: documents are
range-partitioned by doc_id and files cut within partitions.

Defined cases: null and empty text is the end id alone; null doc_id comes first;
documents with equal doc_id stand next to each other in the order of their text;
an empty table gives no files; extra columns are ignored; a document longer than
``FILE_TOKENS`` gets a file of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.tokens import WordTokens, default_path
from strandline.runtime import ensure_checkpoint_dir, ship, shuffle_partitions, table

MAGIC = b"DACTOK1\0"
END_ID = 0
#: A file is closed when it has so many tokens.
FILE_TOKENS = 2_000_000
BLOCK = 512


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, low bits first: a byte for each level."""
    return [8] * max(1, -(-int(ids.max()).bit_length() // 8) if len(ids) else 1)


def encode_file(doc_ids: list[int | None], n_tokens: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, index of documents, levels with bitmap and rank directory."""
    widths = chunk_widths(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<QQB", len(ids), len(doc_ids), len(widths)), bytes(widths), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), n_tokens.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for k, w in enumerate(widths):
        chunks = (rest & np.uint32((1 << w) - 1)).astype(f"<u{w // 8}").tobytes()
        out += [struct.pack("<QQ", len(rest), len(chunks)), chunks]
        rest = rest >> np.uint32(w)
        if k + 1 < len(widths):
            on = rest > 0
            pad = np.zeros(-(-max(1, len(on)) // BLOCK) * BLOCK, bool)
            pad[: len(on)] = on
            ranks = np.concatenate([[0], np.cumsum(pad.reshape(-1, BLOCK).sum(1))])[:-1]
            out += [np.packbits(pad, bitorder="little").tobytes(), ranks.astype("<u8").tobytes()]
            rest = rest[on]
    return b"".join(out)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


class TokenFile:
    """Reads a file made by ``encode_file``; ``tokens`` touches only what the wanted tokens need."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_docs, levels = struct.unpack_from("<QQB", view, 8)
        at = 25
        self.widths = list(view[at : at + levels])
        at += levels
        self._known = np.frombuffer(view[at : at + self.n_docs], np.uint8)
        at += self.n_docs
        self._ids = np.frombuffer(view[at : at + 8 * self.n_docs], "<i8")
        at += 8 * self.n_docs
        self.n_tokens = np.frombuffer(view[at : at + 8 * self.n_docs], "<u8").astype(np.int64)
        at += 8 * self.n_docs
        self._levels = []
        for k in range(levels):
            m, size = struct.unpack_from("<QQ", view, at)
            at += 16
            chunks, bits, ranks = view[at : at + size], None, None
            at += size
            if k + 1 < levels:
                blocks = -(-max(1, m) // BLOCK)
                bits = np.frombuffer(view[at : at + blocks * BLOCK // 8], np.uint8)
                at += blocks * BLOCK // 8
                ranks = np.frombuffer(view[at : at + 8 * blocks], "<u8").astype(np.int64)
                at += 8 * blocks
            self._levels.append((chunks, bits, ranks))

    @property
    def doc_ids(self) -> list[int | None]:
        return [i if k else None for i, k in zip(self._ids.tolist(), self._known.tolist(), strict=True)]

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n_tokens)])

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at these places, in any order."""
        out, shift = np.zeros(len(places), np.uint64), 0
        alive, at = np.arange(len(places)), places.astype(np.int64)
        for w, (chunks, bits, ranks) in zip(self.widths, self._levels, strict=True):
            out[alive] |= np.frombuffer(chunks, f"<u{w // 8}")[at].astype(np.uint64) << np.uint64(shift)
            shift += w
            if bits is None:
                break
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive, at = alive[on], at[on]
            at = self._rank(bits, ranks, at)
        return out.astype(np.uint32)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, then the bytes since."""
        if not len(at):
            return at
        block, byte = at // BLOCK, at >> 3
        lo = int(block[0] if len(at) == 1 else block.min()) * (BLOCK // 8)
        hi = int(byte.max()) + 1
        ones = np.concatenate([[0], np.cumsum(_ONES[bits[lo:hi]], dtype=np.int64)])
        since = ones[byte - lo] - ones[block * (BLOCK // 8) - lo]
        last = _ONES[bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
        return ranks[block] + since + last

    def token(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1: a run on every level, found by two ranks."""
        out, shift, alive = np.zeros(hi - lo, np.uint32), 0, None
        for w, (chunks, bits, ranks) in zip(self.widths, self._levels, strict=True):
            part = np.frombuffer(chunks, f"<u{w // 8}")[lo:hi].astype(np.uint32)
            if alive is None:
                out[:] = part
            else:
                out[alive] |= part << np.uint32(shift)
            shift += w
            if bits is None or lo == hi:
                break
            on = np.flatnonzero(np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo])
            alive = on if alive is None else alive[on]
            lo = int(self._rank(bits, ranks, np.array([lo]))[0])
            hi = lo + len(on)
        return out


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None, file_tokens: int = FILE_TOKENS) -> None:
    """Write the ids of ``docs`` to files in ascending doc_id order: a table of part, seq, n_docs, n_tokens, payload."""
    spark = docs.sparkSession
    ship(spark)
    name = tokenizer or default_path()
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    files = ordered.mapInArrow(lambda b: _files(b, name, end_id, file_tokens), "part bigint, seq bigint, n_docs bigint, n_tokens bigint, payload binary")
    files.write.parquet(path)


def _files(batches: Iterator[pa.RecordBatch], name: str, end_id: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    tok, part, seq = WordTokens.of(name), TaskContext.get().partitionId(), 0
    end = int(end_id).to_bytes(4, "little")
    docs, raws, total = [], [], 0

    def close():
        nonlocal docs, raws, total, seq
        payload = encode_file(docs, np.array([len(r) // 4 for r in raws], np.int64), np.frombuffer(b"".join(raws), "<u4"))
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": total, "payload": payload}], schema=pa.schema([(c, pa.int64()) for c in ("part", "seq", "n_docs", "n_tokens")] + [("payload", pa.binary())]))
        docs, raws, total, seq = [], [], 0, seq + 1
        return row

    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), tok.encode_all(b.column(1)), strict=True):
            docs.append(doc), raws.append(raw + end)
            total += len(raws[-1]) // 4
            if total >= file_tokens:
                yield close()
    if docs:
        yield close()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    ship(spark)
    files = spark.read.schema("part bigint, seq bigint, n_docs bigint, n_tokens bigint, payload binary").parquet(path)
    # tokens before each file: over partitions first, then inside them
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    heads = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before("part").orderBy("seq")), F.lit(0)).alias("_inner")).join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_inner")).alias("_start"))
    docs = files.select("part", "seq", "payload").mapInArrow(_documents, "part bigint, seq bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(heads, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            f = TokenFile(raw.as_buffer())
            ids = f.tokens(0, f.n).astype("<u4").tobytes()
            s = f.starts.tolist()
            crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(s, s[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * f.n_docs, pa.int64()), pa.array([seq] * f.n_docs, pa.int64()), pa.array(f.doc_ids, pa.int64()), pa.array(s[:-1], pa.int64()), pa.array(f.n_tokens), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
