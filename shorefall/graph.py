"""Connected components by randomised contraction.

Every round each node picks the neighbour (or itself) that is smallest in a hash order drawn anew for the
round, and edges are relabelled by the picks. Random orders make the expected shrinkage a constant factor,
so a path of n nodes takes O(log n) rounds. The picks are plain aggregates (combined map-side) and the
relabelling plain joins, whose skewed partitions AQE can split, so a hub does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node that it can reach.

    Null ends and loops are dropped; repeated edges do not matter; an empty table gives an empty one.
    """
    rank = lambda x, k: F.struct(F.xxhash64(x, F.lit(k)).alias("r"), x.alias("x"))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = scratch.save(
        edges.select(*ordered(F.col(src), F.col(dst))).where("a is not null and b is not null and a <> b").distinct()
    )
    picks: list[DataFrame] = []
    while not live.isEmpty():
        k = len(picks)
        both = live.union(live.select("b", "a"))
        pick = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"), k)).alias("m"))
        pick = scratch.save(pick.select("node", F.least("m", rank(F.col("node"), k))["x"].alias("to")))
        picks.append(pick)
        moved = (
            live.join(pick.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(pick.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(*ordered(F.col("ta"), F.col("tb")))
            .distinct()
        )
        done, live = live, scratch.save(moved)
        scratch.drop(done)
    if not picks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = picks[0]
    for pick in picks[1:]:
        nxt = pick.select(F.col("node").alias("to"), F.col("to").alias("then"))
        at = at.join(nxt, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    at = scratch.save(at)
    scratch.drop(live, *picks)
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
