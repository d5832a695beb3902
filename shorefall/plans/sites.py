"""Paired series at sites: distances, agreement, trends and bootstrap intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_distance_summary(rows: DataFrame, column: str = "distances") -> DataFrame:
    """(set, minimum_m, maximum_m, mean_m, median_m) of a JSON map of site to metres in each row."""
    each = rows.select("set", F.explode(F.from_json(column, "map<string,double>")).alias("site", "m"))
    return each.groupBy("set").agg(F.min("m").alias("minimum_m"), F.max("m").alias("maximum_m"), F.avg("m").alias("mean_m"), F.median("m").alias("median_m"))


def site_consistency(pairs: DataFrame) -> DataFrame:
    """(site, n, r, rmse) of paired values a and b; pairs with a null take no part."""
    d = F.col("a") - F.col("b")
    return pairs.where("a is not null and b is not null").groupBy("site").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.sqrt(F.avg(d * d)).alias("rmse"))


def site_trend(series: DataFrame, origin: float = 0.0) -> DataFrame:
    """(site, n, c0, c1, c2): least-squares c0 + c1 (t - origin) + c2 (t - origin)^2; nulls where t has under three values.

    Sums run over t put to [-1, 1] by the ends of the site's range, so they are as well conditioned for calendar years as
    for any other t, and partial sums of one site can be added in any order. Give an origin near the data where c0 and
    c1 matter: far from it they cancel. Values that are null, NaN or infinite take no part.
    """
    t, y = F.col("t").cast("double"), F.col("y").cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    used = series.where(finite(t) & finite(y)).select("site", t.alias("t"), y.alias("y"))
    ends = used.groupBy("site").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("site", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("mid"), F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 2).alias("half"))
    put = used.join(ends, "site").withColumn("u", F.coalesce((F.col("t") - F.col("mid")) / F.col("half"), F.lit(0.0)))
    u, c = F.col("u"), F.col
    sums = [F.sum(F.pow(u, k)).alias(f"s{k}") for k in range(1, 5)] + [F.sum(c("y") * F.pow(u, k)).alias(f"q{k}") for k in range(3)]
    inside = F.count_if((c("t") > c("lo")) & (c("t") < c("hi"))).alias("inside")
    s = put.groupBy("site", "mid", "half").agg(F.count("*").cast("double").alias("s0"), inside, *sums)

    def det(m: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    rows = [[c("s0"), c("s1"), c("s2")], [c("s1"), c("s2"), c("s3")], [c("s2"), c("s3"), c("s4")]]
    right = [c("q0"), c("q1"), c("q2")]
    solve = lambda k: F.when(c("inside") > 0, F.try_divide(det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]), det(rows)))
    s = s.select("site", c("s0").cast("long").alias("n"), ((c("mid") - origin) / c("half")).alias("m"), "half", *[solve(k).alias(f"b{k}") for k in range(3)])
    m, b0, b1, b2 = c("m"), c("b0"), c("b1"), c("b2")
    return s.select("site", "n", (b0 - b1 * m + b2 * m * m).alias("c0"), ((b1 - 2 * b2 * m) / c("half")).alias("c1"), (b2 / (c("half") * c("half"))).alias("c2"))


def draws(seed: int, site: str, rep: int, first: int, end: int, n: int) -> np.ndarray:
    """Places in [0, n) of the draws first to end - 1 of a replicate, which any engine with MD5 repeats."""
    head, md5 = f"{seed}|{site}|{rep}|".encode(), hashlib.md5
    taken = b"".join([md5(b"%b%d" % (head, k)).digest()[:4] for k in range(first, end)])
    return np.frombuffer(taken, ">u4").astype(np.int64) % n


#: Squares of a block and draws made at once, and replicates whose draws of a block meet in a task.
SQUARES, TOGETHER = 1 << 16, 25


def bootstrap_rmse(resid: DataFrame, n_rep: int = 20, seed: int = 1) -> DataFrame:
    """(site, rmse_low, rmse_high): 2.5 and 97.5 percentiles of the RMSE over resampled residuals.

    resid: site, i (0 to n - 1 within a site), e; a null residual adds nothing. Draws are made in pieces wherever there is room and travel as
    arrays of places to the blocks of squares that they fall into; a block gives a sum for each replicate. So a
    site of any size is many pieces and blocks, and a draw costs four bytes of a shuffle.
    """
    size = resid.groupBy("site").agg(F.count("*").alias("n"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(-(-n_rep // TOGETHER) - 1))).alias("g")
    pieces = size.select("site", F.col("site").cast("string").alias("name"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SQUARES}"))).alias("c")).select("*", groups)
    site = resid.schema["site"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for k in range(len(batch)):
                name, n, c, g = (batch.column(j)[k].as_py() for j in (1, 2, 3, 4))
                out = []
                for rep in range(g * TOGETHER + 1, min((g + 1) * TOGETHER, n_rep) + 1):
                    at = np.sort(draws(seed, str(name), rep, c * SQUARES, min(n, (c + 1) * SQUARES), n))
                    cut = np.flatnonzero(np.diff(at // SQUARES)) + 1
                    out += [(int(own[0] // SQUARES), rep, (own % SQUARES).astype(np.int32)) for own in np.split(at, cut)]
                places = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(o[2]) for o in out)]).astype(np.int32)), pa.array(np.concatenate([o[2] for o in out])))
                same = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(out))
                yield pa.RecordBatch.from_arrays([same, pa.array([o[0] for o in out], pa.int64()), pa.array([g] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.int32()), places], ["site", "block", "g", "rep", "places"])

    parts = int(resid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = pieces.repartition(4 * parts, "site", "c", "g").mapInArrow(make, f"site {site}, block long, g int, rep int, places array<int>")
    e = F.col("e").cast("double")
    squares = resid.select("site", F.expr(f"i div {SQUARES}").alias("block"), (F.col("i") % SQUARES).cast("int").alias("at"), F.coalesce(e * e, F.lit(0.0)).alias("ee")).select("*", groups)

    def add(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return pa.table([asked.column("site").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64())], ["site", "rep", "s"])
        ee = np.zeros(SQUARES)
        ee[own.column("at").to_numpy()] = own.column("ee").to_numpy()
        lists = asked.column("places").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        total = np.concatenate([[0.0], np.cumsum(ee[lists.flatten().to_numpy()])])
        return pa.table([asked.column("site"), asked.column("rep"), pa.array(total[ends[1:]] - total[ends[:-1]])], ["site", "rep", "s"])

    key = ["site", "block", "g"]
    sums = squares.groupBy(key).cogroup(drawn.groupBy(key)).applyInArrow(add, f"site {site}, rep int, s double")
    each = sums.groupBy("site", "rep").agg(F.sum("s").alias("s")).join(size, "site").withColumn("rmse", F.sqrt(F.greatest("s", F.lit(0.0)) / F.col("n")))
    return each.groupBy("site").agg(F.percentile("rmse", 0.025).alias("rmse_low"), F.percentile("rmse", 0.975).alias("rmse_high"))
