"""Word and label expressions that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as bigint: splits, less the empty pieces at either end."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    edge = lambda k: F.when(F.element_at(parts, k) == "", 1).otherwise(0)
    n = F.size(parts)
    return (n - edge(1) - F.when(n > 1, edge(-1)).otherwise(0)).cast("bigint")


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name: extra columns with clashing names go."""
    return df.select(*[F.col(f"`{n}`") for n in names])
