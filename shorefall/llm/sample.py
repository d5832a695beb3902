"""Bounded samples that are the same for the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 30


def bounded(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """At most ``size`` rows: those with the smallest hashes of the columns, in that order.

    Counts first and sorts only rows whose hash is small enough, so that a few more than ``size`` rows meet in
    one place, however many partitions there are. Columns should tell rows apart.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(1 << BITS))
    if n > size:
        share = min(1.0, (1.2 * size + 8 * size**0.5 + 20) / n)
        df = df.where(place < int(share * (1 << BITS)) + 1)
    return df.orderBy(place, *columns).limit(size)
