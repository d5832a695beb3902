"""Resampling between grids whose axes are parallel: overlap and bilinear weights split into one axis table each.

An axis table has a row or two for each line of the finer grid, so it grows with the square root of the grid; it
is broadcast while it is below AXIS_ROWS and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridSpec, row_area_table

#: Rows of an axis table or a population grid that are broadcast at most.
AXIS_ROWS = 2_000_000
TINY = 1e-9


def small(df: DataFrame, rows: int, limit: int = AXIS_ROWS) -> DataFrame:
    """A broadcast hint where the number of rows is known to be small enough."""
    return F.broadcast(df) if rows <= limit else df


def axis_overlap(spark: SparkSession, src0: float, dsrc: float, nsrc: int, dst0: float, ddst: float, ndst: int) -> DataFrame:
    """(src, dst, w): the part of each destination line that a source line covers."""
    one = (F.lit(src0) + F.lit(dsrc) * F.col("id") - F.lit(dst0)) / F.lit(ddst)
    two = (F.lit(src0) + F.lit(dsrc) * (F.col("id") + 1) - F.lit(dst0)) / F.lit(ddst)
    lines = spark.range(nsrc).select(F.col("id").cast("int").alias("src"), one.alias("u"), two.alias("v"))
    both = lines.select("src", "u", "v", F.explode(F.sequence(F.floor("u").cast("int"), F.floor("v").cast("int"))).alias("dst"))
    w = F.least("v", F.col("dst") + 1) - F.greatest("u", F.col("dst"))
    return both.select("src", "dst", w.alias("w")).where((F.col("w") > TINY) & F.col("dst").between(0, ndst - 1))


def axis_bilinear(spark: SparkSession, dst0: float, ddst: float, ndst: int, src0: float, dsrc: float, nsrc: int) -> DataFrame:
    """(dst, src, w): for each destination line the first of the two source lines whose centres enclose its centre, and the second's weight.

    src goes from -1 to nsrc - 1; lines beyond have no row.
    """
    u = (F.lit(dst0) + F.lit(ddst) * (F.col("id") + 0.5) - F.lit(src0)) / F.lit(dsrc) - 0.5
    lines = spark.range(ndst).select(F.col("id").cast("int").alias("dst"), F.floor(u).cast("int").alias("src"), (u - F.floor(u)).alias("w"))
    return lines.where(F.col("src").between(-1, nsrc - 1))


def _axes(spark: SparkSession, src: GridSpec, dst: GridSpec) -> tuple[DataFrame, DataFrame]:
    src.check_same_crs(dst)
    x = axis_overlap(spark, src.x0, src.dx, src.ncols, dst.x0, dst.dx, dst.ncols).toDF("col", "dcol", "wx")
    y = axis_overlap(spark, src.y0, src.dy, src.nrows, dst.y0, dst.dy, dst.nrows).toDF("row", "drow", "wy")
    return x, y


def overlap_fraction(mask: DataFrame, src: GridSpec, dst: GridSpec, by: tuple[str, ...] = (), value: Column | None = None, denominator: str = "contributing", each: Column | None = None) -> DataFrame:
    """(*by, drow, dcol, fraction): area-weighted mean of a mask's true cells (or of ``value``) over coarse cells.

    mask: true cells only (row, col). denominator "contributing" divides by the source cells that cover a
    coarse cell, so that one partly off the source grid is not diluted; "full" by the whole coarse cell.
    Partial sums by coarse cell are made before the shuffle. Coarse cells without a true cell have no row.
    each: an array of the cases that the cell belongs to; the result has one more column ``case``. Cells are
    multiplied by their cases only behind the joins with the axes.
    """
    spark = mask.sparkSession
    x, y = _axes(spark, src, dst)
    x_all, y_all = x.groupBy("dcol").agg(F.sum("wx").alias("sx")), y.groupBy("drow").agg(F.sum("wy").alias("sy"))
    cells = mask.join(small(x, 2 * src.ncols), "col").join(small(y, 2 * src.nrows), "row")
    weight = F.col("wx") * F.col("wy") * (F.lit(1.0) if value is None else value)
    if each is not None:
        cells, by = cells.withColumn("case", F.explode(each)), (*by, "case")
    sums = cells.groupBy(*by, "drow", "dcol").agg(F.sum(weight).alias("w"))
    if denominator == "contributing":
        sums = sums.join(small(x_all, dst.ncols), "dcol").join(small(y_all, dst.nrows), "drow")
        fraction = F.col("w") / (F.col("sx") * F.col("sy"))
    else:
        fraction = F.col("w")
    return sums.select(*by, "drow", "dcol", F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)).alias("fraction"))


def population_overlap(mask: DataFrame, src: GridSpec, population: DataFrame, pop_grid: GridSpec, variants: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, *variants, population): sum of population x covered fraction; missing and negative population counts as none.

    population: prow, pcol, population and the columns of ``variants``; the mask is resampled once for all of them.
    by: columns that tell masks apart.
    """
    fraction = overlap_fraction(mask, src, pop_grid, by)
    people = population.where("population >= 0 and not isnan(population)").withColumnsRenamed({"prow": "drow", "pcol": "dcol"})
    return fraction.join(people, ["drow", "dcol"]).groupBy(*by, *variants).agg(F.sum(F.col("population") * F.col("fraction")).alias("population"))


def class_fraction(classes: DataFrame, class_value: int, src: GridSpec, dst: GridSpec) -> DataFrame:
    """(row, col, fraction) of the destination cells that hold some of the class."""
    out = overlap_fraction(classes.where(F.col("class") == class_value), src, dst)
    return out.select(F.col("drow").alias("row"), F.col("dcol").alias("col"), "fraction")


def merge_max(*fractions: DataFrame) -> DataFrame:
    """(row, col, fraction): the largest of overlapping tiles."""
    out = fractions[0]
    for f in fractions[1:]:
        out = out.unionByName(f)
    return out.groupBy("row", "col").agg(F.max("fraction").alias("fraction"))


def density(population: DataFrame, pop_grid: GridSpec) -> DataFrame:
    """(prow, pcol, density): people a km2 of the grid's own cells, 32-bit; missing, negative and undefined are 0."""
    area = row_area_table(population.sparkSession, pop_grid).withColumnRenamed("row", "prow")
    people = F.when((F.col("population") >= 0) & ~F.isnan("population"), F.col("population").cast("float"))
    each = F.coalesce(F.try_divide(people.cast("double"), F.col("area_km2")), F.lit(0.0))
    return population.join(small(area, pop_grid.nrows), "prow").select("prow", "pcol", F.when(F.abs(each) == float("inf"), 0.0).otherwise(each).cast("float").alias("density"))


def density_on_grid(population: DataFrame, pop_grid: GridSpec, grid: GridSpec, cells: DataFrame) -> DataFrame:
    """Columns of ``cells`` and density: bilinear in the enclosing centres, weights renormalised over those that exist; 0 where none does.

    The coarse grid is turned into squares of four neighbouring densities first, so that a cell looks one row up.
    """
    grid.check_same_crs(pop_grid)
    spark = cells.sparkSession
    x = axis_bilinear(spark, grid.x0, grid.dx, grid.ncols, pop_grid.x0, pop_grid.dx, pop_grid.ncols).toDF("col", "__j", "__wx")
    y = axis_bilinear(spark, grid.y0, grid.dy, grid.nrows, pop_grid.y0, pop_grid.dy, pop_grid.nrows).toDF("row", "__i", "__wy")
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners])).alias("at")
    spread = density(population, pop_grid).select("prow", "pcol", "density", corner)
    square = spread.groupBy((F.col("prow") - F.col("at.a")).alias("__i"), (F.col("pcol") - F.col("at.b")).alias("__j")).agg(
        *[F.max(F.when((F.col("at.a") == a) & (F.col("at.b") == b), F.col("density"))).alias(f"__d{a}{b}") for a, b in corners]
    )
    found = cells.join(small(x, grid.ncols), "col", "left").join(small(y, grid.nrows), "row", "left")
    found = found.join(small(square, (pop_grid.nrows + 1) * (pop_grid.ncols + 1)), ["__i", "__j"], "left")
    part = lambda a, k: F.col(k) if a else 1 - F.col(k)
    weights = [(F.col(f"__d{a}{b}"), part(a, "__wy") * part(b, "__wx")) for a, b in corners]
    there = lambda v: sum((F.when(d.isNotNull(), v(d, w)).otherwise(0.0) for d, w in weights), F.lit(0.0))
    mean = F.try_divide(there(lambda d, w: w * d), there(lambda d, w: w))
    return found.select(*cells.columns, F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0)).cast("float").alias("density"))


def masked_density(dense: DataFrame, flood: DataFrame) -> DataFrame:
    """Density cells that a case floods."""
    return dense.join(flood.select("row", "col"), ["row", "col"], "left_semi")
