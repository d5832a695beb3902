"""Grids, scenarios, populations, classes, units and sites derived from the driver's tables.

Every frame here is also given as SQL in ``fixture_sql`` for the other engine.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import clean_subsidence
from ..grid import GridSpec
from ..sources.bands import valid_value

NCOLS, POP_COLS, CLASS_COLS = 100, 36, 122
X0, Y0, STEP, POP_STEP, CLASS_STEP = 112.0, 22.8, 0.0005, 0.0014, 0.00041
#: scenario, year, level without added water
LEVELS = [("SSP2-4.5", 2050, 1.138469235), ("SSP2-4.5", 2100, 1.515469235), ("SSP5-8.5", 2050, 1.167469235), ("SSP5-8.5", 2100, 1.732469235)]
ADDED = (0.0, 1.5, 3.0)
SCENARIOS = [SimpleNamespace(scenario=s, year=y, added_water_m=a, water_level_egm2008_m=h + a) for s, y, h in LEVELS for a in ADDED]
TARGET = next(s for s in SCENARIOS if (s.scenario, s.year, s.added_water_m) == ("SSP5-8.5", 2100, 0.0))
POP_VARIANTS = [("SSP2", 2020, 1.0), ("SSP2", 2050, 1.1), ("SSP2", 2100, 0.8), ("SSP5", 2050, 1.05), ("SSP5", 2100, 0.7)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col and the raw bands; -9999 is no data."""
    e = read(spark, sf_dir, "events")
    none = F.lit(-9999.0).cast("float")
    rate = F.when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), none).otherwise((F.col("user_id") % 150 / 3000.0).cast("float"))
    sub = lambda years, cap: F.when(F.col("rate") == -9999, none).otherwise(F.least(F.col("rate").cast("double") * years, F.lit(cap)).cast("float"))
    out = e.select(
        F.expr("cast(event_id div 100 as int)").alias("row"), (F.col("event_id") % 100).cast("int").alias("col"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 150), none).otherwise((F.col("value") / 25.0).cast("float")).alias("dem"),
        F.when((F.col("event_id") % 100 < 8) | ((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)), 0).otherwise(1).alias("land_raw"),
        rate.alias("rate"),
    )
    return out.withColumns({"sub_2050": sub(25, 1.5), "sub_2100": sub(75, 3.0)})


def grid_of(spark: SparkSession, sf_dir: str) -> GridSpec:
    rows = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // NCOLS + 1
    return GridSpec(X0, STEP, Y0, -STEP, rows, NCOLS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide cells: no data is null; land, common, and cleaned rate and subsidence beside the raw bands."""
    bands = raw_bands(spark, sf_dir)
    out = bands.withColumns({b: valid_value(F.col(b)) for b in ("dem", "rate", "sub_2050", "sub_2100")})
    out = out.withColumn("land", (F.col("land_raw") > 0) & F.col("dem").isNotNull())
    support = F.col("rate").isNotNull() & F.col("sub_2050").isNotNull() & F.col("sub_2100").isNotNull()
    clean = {f"{b}_clean": clean_subsidence(F.col(b)) for b in ("rate", "sub_2050", "sub_2100")}
    return out.withColumn("common", F.col("land") & support).withColumns(clean)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pop_scenario, year, prow, pcol, population (negative: missing)."""
    variant = F.inline(F.array(*[F.struct(F.lit(s).alias("pop_scenario"), F.lit(y).alias("year"), F.lit(f).alias("factor")) for s, y, f in POP_VARIANTS]))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", variant)
    return c.select("pop_scenario", "year", F.expr(f"cast(c_custkey div {POP_COLS} as int)").alias("prow"), (F.col("c_custkey") % POP_COLS).cast("int").alias("pcol"), (F.col("c_acctbal") * F.col("factor")).alias("population"))


def pop_grid_of(spark: SparkSession, sf_dir: str) -> GridSpec:
    rows = read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] // POP_COLS + 1
    return GridSpec(X0, POP_STEP, Y0, -POP_STEP, rows, POP_COLS)


def classes(spark: SparkSession, sf_dir: str, tile: int | None = None) -> DataFrame:
    """row, col, class: 50 is built-up; of a tile, cells of the other parity are class 0."""
    o = read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderpriority") == "1-URGENT", 50).otherwise(10)
    if tile is not None:
        value = F.when(F.col("o_orderkey") % 2 == tile, value).otherwise(0)
    return o.select(F.expr(f"cast(o_orderkey div {CLASS_COLS} as int)").alias("row"), (F.col("o_orderkey") % CLASS_COLS).cast("int").alias("col"), value.alias("class"))


def class_grid_of(spark: SparkSession, sf_dir: str) -> GridSpec:
    rows = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // CLASS_COLS + 1
    return GridSpec(X0, CLASS_STEP, Y0, -CLASS_STEP, rows, CLASS_COLS)


def unit_rings(spark: SparkSession, sf_dir: str, grid: GridSpec) -> DataFrame:
    """unit_id, name, ring, cx, cy, ax, ay: a diamond (and a hole for even keys) in each of 5 x 5 blocks; one rectangle in the sea."""
    bw, bh = grid.dx * grid.ncols / 5, grid.dy * grid.nrows / 5
    n = read(spark, sf_dir, "nation").where("n_nationkey < 25")
    k = F.col("n_nationkey")
    cx, cy = F.lit(grid.x0) + F.lit(bw) * (k % 5 + 0.5), F.lit(grid.y0) + F.lit(bh) * (F.floor(k / 5) + 0.5)
    ring = F.inline(F.when(k % 2 == 0, F.array(F.struct(F.lit(0).alias("ring"), F.lit(0.93).alias("s")), F.struct(F.lit(1).alias("ring"), F.lit(0.31).alias("s")))).otherwise(F.array(F.struct(F.lit(0).alias("ring"), F.lit(0.93).alias("s")))))
    return n.select(k.alias("unit_id"), F.col("n_name").alias("name"), cx.alias("cx"), cy.alias("cy"), ring).select(
        "unit_id", "name", "ring", "cx", "cy", (F.lit(bw / 2) * F.col("s")).alias("ax"), (F.lit(bh / 2) * F.col("s")).alias("ay")
    )


def unit_corners(spark: SparkSession, sf_dir: str, grid: GridSpec) -> DataFrame:
    """unit_id, name, ring, corners array<struct<x, y>>, closed; with the rectangle in the open sea."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy, ax, ay = (F.col(c) for c in ("cx", "cy", "ax", "ay"))
    diamond = F.array(p(cx + ax, cy), p(cx, cy + ay), p(cx - ax, cy), p(cx, cy - ay), p(cx + ax, cy))
    units = unit_rings(spark, sf_dir, grid).select("unit_id", "name", "ring", diamond.alias("corners"))
    west, east = grid.x0 + 1.25 * grid.dx, grid.x0 + 5.75 * grid.dx
    north, south = grid.y0 + 1.25 * grid.dy, grid.y0 + (grid.nrows - 1.25) * grid.dy
    box = F.array(*[p(F.lit(x), F.lit(y)) for x, y in ((west, north), (east, north), (east, south), (west, south), (west, north))])
    sea = read(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.lit(25).alias("unit_id"), F.lit("SEA").alias("name"), F.lit(0).alias("ring"), box.alias("corners"))
    return units.unionByName(sea)


def unit_edges(spark: SparkSession, sf_dir: str, grid: GridSpec) -> DataFrame:
    c = unit_corners(spark, sf_dir, grid)
    e = F.explode(F.arrays_zip(F.slice("corners", 1, F.size("corners") - 1).alias("a"), F.slice("corners", 2, F.size("corners") - 1).alias("b")))
    return c.select("unit_id", F.lit(0).alias("part"), "ring", e.alias("e")).select("unit_id", "part", "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def units(spark: SparkSession, sf_dir: str, grid: GridSpec) -> DataFrame:
    return unit_corners(spark, sf_dir, grid).select("unit_id", "name").distinct()


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    lon, lat = 112.0 + 0.0005 * (s % 100) + 0.0001, 22.8 - 0.0005 * (F.floor(s / 100) % 10) - 0.0002
    return read(spark, sf_dir, "supplier").select(s.alias("site"), lon.alias("lon"), lat.alias("lat"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, a, b, t (years since 1992, less 3.5)."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (days / 365.25 - 3.5).alias("t"))
