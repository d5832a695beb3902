"""Masks as runs: (mask, row, start, stop) of true cells side by side, stop excluded.

Areas, overlaps with coarser grids and differences cost runs, not cells; a run covers a coarse line by its two ends alone, so no
axis is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridSpec, row_area_table
from .resample import TINY, axis_overlap, small

#: Columns of a grid row that are put together at once; a run goes on beyond as another one.
SPAN = 4096


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of a boolean array's runs."""
    rows, cols = mask.shape
    padded = np.zeros((rows, cols + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded.ravel())
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    width = cols + 2
    return start // width, start % width, stop % width


def runs_table(masks, row0: int = 0, col0: int = 0) -> pa.Table:
    """Runs of (number, boolean array) pairs, moved to where the arrays lie."""
    out = [[np.zeros(0, np.int64)] * 4]
    for k, mask in masks:
        r, a, b = mask_runs(mask)
        out.append([np.full(len(r), k), r + row0, a + col0, b + col0])
    return pa.table([pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*out)], ["mask", "row", "start", "stop"])


def cells_to_runs(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, row, start, stop) of true cells (row, col); repeated cells count once. Runs end at every SPAN columns."""
    part = Window.partitionBy(*by, "row", F.floor(F.col("col") / SPAN)).orderBy("col")
    cells = cells.select(*by, "row", "col").distinct()
    own = cells.withColumn("__run", F.col("col") - F.row_number().over(part)).withColumn("__span", F.floor(F.col("col") / SPAN))
    runs = own.groupBy(*by, "row", "__span", "__run").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("stop"))
    return runs.drop("__span", "__run")


def runs_to_cells(runs: DataFrame) -> DataFrame:
    """The cells (..., row, col) of runs."""
    return runs.withColumn("col", F.explode(F.sequence(F.col("start"), F.col("stop") - 1))).drop("start", "stop")


def run_area(runs: DataFrame, grid: GridSpec, by: tuple[str, ...] = ("mask",)) -> DataFrame:
    """(*by, pixels, area_km2)."""
    rows = runs.groupBy(*by, "row").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    rows = rows.join(small(row_area_table(runs.sparkSession, grid), grid.nrows), "row")
    return rows.groupBy(*by).agg(F.sum("n").alias("pixels"), F.sum(F.col("n") * F.col("area_km2")).alias("area_km2"))


def run_overlap(runs: DataFrame, src: GridSpec, dst: GridSpec, by: tuple[str, ...] = ("mask",)) -> DataFrame:
    """(*by, drow, dcol, fraction): ``overlap_fraction`` of masks as runs, over the source cells that cover a coarse cell."""
    src.check_same_crs(dst)
    spark = runs.sparkSession
    # a source line's ends in coarse lines; two neighbours share an end, so the parts of a run's cells add up to the run
    at = lambda c, s0, ds, d0, dd: (F.lit(s0) + F.lit(ds) * c - F.lit(d0)) / F.lit(dd)
    ends = runs.select(*by, "row", at(F.col("start"), src.x0, src.dx, dst.x0, dst.dx).alias("u"), at(F.col("stop"), src.x0, src.dx, dst.x0, dst.dx).alias("v"))
    low, high = F.greatest(F.floor("u"), F.lit(0)).cast("int"), F.least(F.floor("v"), F.lit(dst.ncols - 1)).cast("int")
    wide = ends.where(low <= high).withColumn("dcol", F.explode(F.sequence(low, high)))
    wide = wide.withColumn("wx", F.least("v", F.col("dcol") + 1) - F.greatest("u", F.col("dcol"))).where(F.col("wx") > TINY)
    lines = wide.groupBy(*by, "row", "dcol").agg(F.sum("wx").alias("wx"))
    y = axis_overlap(spark, src.y0, src.dy, src.nrows, dst.y0, dst.dy, dst.nrows).toDF("row", "drow", "wy")
    sums = lines.join(small(y, 2 * src.nrows), "row").groupBy(*by, "drow", "dcol").agg(F.sum(F.col("wx") * F.col("wy")).alias("w"))
    x = axis_overlap(spark, src.x0, src.dx, src.ncols, dst.x0, dst.dx, dst.ncols).toDF("col", "dcol", "wx")
    sums = sums.join(small(x.groupBy("dcol").agg(F.sum("wx").alias("sx")), dst.ncols), "dcol").join(small(y.groupBy("drow").agg(F.sum("wy").alias("sy")), dst.nrows), "drow")
    return sums.select(*by, "drow", "dcol", F.least(F.greatest(F.col("w") / (F.col("sx") * F.col("sy")), F.lit(0.0)), F.lit(1.0)).alias("fraction"))
