"""Character n-gram hashes of many texts at once, and labelled samples for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.words import crc_remainder

#: Characters that are hashed at a time.
STRIDE = 400_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def blocks(texts: list[str | None], pad: str = "", lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, first place of each text and the end), for runs of texts of about STRIDE characters."""
    lo = 0
    while lo < len(texts):
        some, size = [], 0
        while lo < len(texts) and (not some or size + len(texts[lo] or "") <= STRIDE):
            t = texts[lo] or ""
            t = pad + (t.lower() if lower else t) + pad if t else ""
            some.append(code_points(t))
            size += len(t)
            lo += 1
        yield np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])])


def gram_hashes(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits for each run of n code points."""
    h = np.full(max(0, len(cp) - n + 1), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h *= np.uint32(0x85EBCA6B)
        h += cp[k : k + len(h)]
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (text, label) for training, and how many labelled rows of each class may be learned from.

    Rows whose crc32(doc_id) modulo ``mod`` is ``held`` are never read for labels.
    Of each class, the ``per_class`` documents with the smallest hash of doc_id are
    taken: a bound that holds at every size. A document with several label rows has
    the largest label; null labels and ids are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(crc_remainder(F.col("doc_id"), mod) != held)
    usable = usable.groupBy("doc_id").agg(F.max(target).alias("_label"))
    counts = {int(r["_label"]): r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = [usable.where(F.col("_label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_id"), "_label")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # at most 2 * per_class ids
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label")).select("text", "_label"), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
