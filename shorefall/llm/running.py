"""Running sums along an order, also where one group holds most of the rows.

Rows are dealt by ranges of group and order, so that a large group lies in many parts. Sums run inside a part, and
what the parts before it hold of the group is added from a small table with a row for each part and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def running(rows: DataFrame, scratch: Scratch, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with sums over the rows before each in its group (its own value not included; 0 at the first).

    Rows should be cheap to read twice (a written table), as Spark samples them for the ranges. Equal rows are dealt apart
    by a number of their own, so many repeats do not meet in one part; which of them comes first is open. Null is a
    group like any other. Names ``__part`` and ``__salt`` must be free.
    """
    last = F.xxhash64("__salt")
    placed = rows.withColumn("__salt", F.monotonically_increasing_id())
    placed = scratch.save(placed.repartitionByRange(*group, *order, last).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", *group).orderBy(*order, last).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"__{n}") for n, v in sums.items()])
    totals = placed.groupBy("__part", *group).agg(*[F.sum(v).alias(f"__{n}") for n, v in sums.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group], *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = inside.join(parts, same)
    return joined.select(*rows.columns, *[(F.col(f"__{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])
