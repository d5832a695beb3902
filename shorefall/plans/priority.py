"""Relative priority PI = S * T * C * P, its top decile in nine cases, and how often cells are in it.

The nine cases stay nine elements of one array per cell, so nothing is shuffled by cell between them; cutoffs are
nine aggregates of one pass.
"""

from __future__ import annotations

import struct
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import DATUM_CI95_M, threshold_proximity
from ..functions.percentile import exact_percentiles
from ..grid import GridSpec
from ..operators.areas import mask_area
from ..operators.flood import Case
from ..operators.spill import flood_by_levels
from ..scratch import Scratch

DEM_OFFSETS, DATUM_OFFSETS = (-0.5, 0.0, 0.5), (-DATUM_CI95_M, 0.0, DATUM_CI95_M)
REACH_M = 0.5


def f32(v: float) -> Column:
    return F.lit(v).cast("float")


def f32_of(v: float | None) -> float:
    """Rounded to a 32-bit float; 0 for none."""
    return 0.0 if v is None else struct.unpack("f", struct.pack("f", v))[0]


def scale_of(cells: DataFrame, value: Column, q: float, domain: Column) -> float:
    """Exact percentile (linear interpolation) over a domain, as a 32-bit float; 0 for an empty one."""
    return f32_of(exact_percentiles(cells.where(domain), [value], q)[0])


def normalise_p(value: Column, scale: float) -> Column:
    """value / scale, clipped to 0..1; 0 where the scale is 0. 32-bit floats."""
    if not scale:
        return f32(0.0)
    return F.least(F.greatest((value.cast("float") / f32(scale)).cast("float"), f32(0.0)), f32(1.0))


def cases_of(level: float, dem_offsets=DEM_OFFSETS, datum_offsets=DATUM_OFFSETS) -> list[tuple[float, float, float]]:
    """(dem offset, datum offset, level), DEM offsets outermost."""
    return [(d, v, level + v) for d, v in product(dem_offsets, datum_offsets)]


def priority_index(rate_norm: Column, pop_norm: Column, dem: Column, level: float, connected: Column) -> Column:
    """S * T * C * P in 32-bit floats, in this order; dem is the elevation with its offset."""
    return ((rate_norm * threshold_proximity(dem, level)).cast("float") * F.when(connected, f32(1.0)).otherwise(f32(0.0))).cast("float") * pop_norm


def priority_cases(cells: DataFrame, grid: GridSpec, level: float, cases=None, **how) -> tuple[DataFrame, dict]:
    """(row, col, priority array<float>) of common cells that some case floods, and the two scales.

    cells: dem, land, common, rate_clean, density.
    """
    cases = cases or cases_of(level)
    common = F.col("common")
    log_pop = F.log1p(F.col("density").cast("double")).cast("float")
    cells = Scratch(cells.sparkSession).save(cells.select("row", "col", "dem", "land", "common", "rate_clean", "density"))  # read by each pass below
    found = exact_percentiles(cells.where(common), [F.col("rate_clean"), log_pop], [0.95, 0.99])
    scales = {"rate_p95": f32_of(found[0]), "pop_log_p99": f32_of(found[1])}
    surfaces = {f"dem_{d}": F.col("dem") + f32(d) for d, _, _ in cases}
    floods = [Case(f"dem_{d}", h + REACH_M) for d, _, h in cases]
    flood = flood_by_levels(cells, grid, surfaces, floods, carry=("common", "rate_clean", "density", "dem"), **how).where(common)
    s, p = normalise_p(F.col("rate_clean"), scales["rate_p95"]), normalise_p(log_pop, scales["pop_log_p99"])
    each = [priority_index(s, p, F.col("dem") + f32(d), h, F.array_contains("hits", k)) for k, (d, _, h) in enumerate(cases)]
    return flood.select("row", "col", F.array(*each).alias("priority")), scales


def cutoffs(priority: DataFrame, n: int) -> list[float]:
    """Each case's 90th percentile of positive values, 0 where there is none."""
    found = exact_percentiles(priority, [F.when(F.col("priority")[k] > 0, F.col("priority")[k]) for k in range(n)], 0.9)
    return [f32_of(v) for v in found]


def hot_flags(priority: DataFrame, cut: list[float]) -> DataFrame:
    """(row, col, hot array<boolean>): the top decile of each case; nothing is hot where the cutoff is 0."""
    return priority.select("row", "col", F.array(*[(F.col("priority")[k] >= f32(c)) & F.lit(c > 0) for k, c in enumerate(cut)]).alias("hot"))


def recurrence(hot: DataFrame, n: int = 9) -> DataFrame:
    """(row, col, hits, frequency) of cells that are hot in some case."""
    hits = F.size(F.filter("hot", lambda h: h))
    return hot.select("row", "col", hits.alias("hits")).where("hits > 0").withColumn("frequency", (F.col("hits") / F.lit(float(n))).cast("float"))


def on_grid(cells: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """All cells with a value of ``found`` (row, col, value), 0 where it has none: the index and its recurrence as a whole grid."""
    all_cells = cells.select("row", "col", "common").join(found.select("row", "col", value), ["row", "col"], "left")
    return all_cells.withColumn(value, F.coalesce(value, f32(0.0)))


def recurrence_areas(found: DataFrame, grid: GridSpec, n: int = 9) -> DataFrame:
    """One row: areas of frequency >= 2/3 and >= 1/3 (compared as integers), and the largest frequency."""
    sums = mask_area(found, grid, two_thirds=F.col("hits") * 3 >= 2 * n, one_third=F.col("hits") * 3 >= n)
    top = found.agg(F.coalesce(F.max("frequency"), f32(0.0)).alias("maximum_frequency"))
    return top.crossJoin(sums.select(F.coalesce("two_thirds_area_km2", F.lit(0.0)).alias("robust_area_km2"), F.coalesce("one_third_area_km2", F.lit(0.0)).alias("moderate_area_km2")))


def priority_summary(cells: DataFrame, grid: GridSpec, level: float, **how) -> DataFrame:
    """One row: the central case's cutoff and area, the recurrence areas, and the scales."""
    cases = cases_of(level)
    found, scales = priority_cases(cells, grid, level, cases, **how)
    found = Scratch(cells.sparkSession).save(found)  # read three times
    cut = cutoffs(found, len(cases))
    k = next(i for i, (d, v, _) in enumerate(cases) if d == 0 and v == 0)
    hot = hot_flags(found, cut)
    central = mask_area(hot.where(F.col("hot")[k]), grid).agg(F.coalesce(F.sum("area_km2"), F.lit(0.0)).alias("central_top_decile_area_km2"))
    out = recurrence_areas(recurrence(hot, len(cases)), grid, len(cases)).crossJoin(central)
    return out.select(
        F.lit(level).alias("target_water_level_egm2008_m"), F.lit(cut[k]).cast("double").alias("central_top_decile_cutoff"), "central_top_decile_area_km2",
        F.col("robust_area_km2"), F.col("moderate_area_km2"), F.col("maximum_frequency").cast("double").alias("maximum_frequency"),
        F.lit(scales["rate_p95"]).cast("double").alias("rate_p95"), F.lit(scales["pop_log_p99"]).cast("double").alias("pop_log_p99"), F.lit(len(cases)).alias("sensitivity_cases"),
    )
