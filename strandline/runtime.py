"""What every operator shares: tables, durable intermediates, shipping of Python code.

Intermediates go to the folder that ``spark.checkpoint.dir`` names, which all
executors share, so that a lost executor costs a re-read and not a failure.
``localCheckpoint`` is never used.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be sent to every executor; beyond it joins shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, cut from its lineage and kept in the shared checkpoint folder.

    Spark's cleaner removes the files when nothing refers to them any more
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandline-")
    sc.setCheckpointDir(named)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="strandline-code-"), "strandline.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(out)
    sc._strandline_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join with a side that is usually small: broadcast when its counted rows are
    within ``BROADCAST_ROWS``, else a shuffled join in which ``big`` is salted, so that
    one hot key is spread over ``salts`` tasks. ``small`` should be durable: it is counted.
    Keys match null-safely."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small, salted = F.broadcast(small), big
    else:
        salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        keys = [*keys, "_salt"]
    r = small.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in small.columns])
    cond = [salted[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return salted.join(r, cond, how).drop(*[f"_r_{k}" for k in keys], "_salt")


def tidy(rows):
    """``rows`` of a Python task; at its end the worker gives freed memory back to the system, as it lives on for other tasks."""
    try:
        yield from rows
    finally:
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
