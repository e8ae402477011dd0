"""Joins that go the same way at every size: a filter of ids before text moves, and an equi-join that deals hot keys to many tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import BROADCAST_ROWS, durable

#: Most bits of a filter of ids (16 MB); it has 16 for an id.
FILTER_BITS = 1 << 27
#: Rows of a key that one task takes at least, before the key is dealt to several.
HOT_ROWS = 512


def id_filter(ids: DataFrame, most: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test, in JVM functions, that holds for every id of the one column of ``ids`` and for few others.

    A Bloom filter: beyond ``most`` bits it only lets more through, so an exact step must follow where that matters."""
    name = ids.columns[0]
    bits = 1 << 12
    while bits < min(most, 16 * ids.count()):
        bits *= 2

    def places(x: Column) -> list[Column]:
        h = F.xxhash64(x)
        step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("bigint"))
        return [(h + k * step).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in range(4)]

    at = ids.select(F.explode(F.array(*places(F.col(name)))).alias("at"))
    got = at.groupBy(F.shiftrightunsigned("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("set")).toArrow()  # at most ``most`` / 8 rows
    filter_ = np.zeros(bits // 8, np.uint8)
    filter_[got.column("byte").to_numpy()] = got.column("set").to_numpy()
    # a scalar subquery: a literal of this size would stand in every description of the plan
    table_ = ids.sparkSession.createDataFrame([(filter_.tobytes(),)], "bits binary").scalar()

    def maybe(x: Column) -> Column:
        ok = x.isNotNull()
        for p in places(x):
            byte = F.conv(F.hex(F.substring(table_, (F.shiftrightunsigned(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            ok = ok & (F.call_function("shiftright", byte, p.bitwiseAND(F.lit(7).cast("bigint")).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return ok

    return maybe


def hot_keys(keys: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Keys of the one column of ``keys`` (durable) that stand there often, and to how many tasks each is to be dealt: at most BROADCAST_ROWS at any size."""
    each = max(rows, -(-keys.count() // BROADCAST_ROWS))
    n = keys.groupBy(F.col(keys.columns[0]).alias("_hot")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > each)
    return durable(n.select("_hot", F.ceil(F.col("_rows") / each).cast("bigint").alias("_deals")))


def spread_join(big: DataFrame, small: DataFrame, key: str, spread: Column, hot: DataFrame) -> DataFrame:
    """Inner equi-join on ``key``. Rows of ``big`` with a hot key are dealt by ``spread`` to as many tasks as ``hot_keys`` says, and such rows of ``small`` are repeated as often."""
    dealt = lambda d, how: d.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_deal", how(F.coalesce("_deals", F.lit(1).cast("bigint")))).drop("_hot", "_deals")
    left = dealt(big, lambda m: F.pmod(F.xxhash64(spread), m))
    right = dealt(small, lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1)))
    return left.join(right, [key, "_deal"]).drop("_deal")
