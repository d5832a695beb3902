"""Domains, areas and shares. Cells are counted by row first, so sums of areas are short and stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import GridSpec, row_area_table
from .resample import small

DOMAINS = ("full_grid_valid", "dem_valid_land", "insar_support_all_cells", "common_analysis_land", "excluded_dem_land")


def domain_masks(cells: DataFrame, support: tuple[str, ...] = ("rate", "sub_2100")) -> DataFrame:
    """Adds the five domain columns. support: layers that must be present (null: no data) in the observed domain."""
    has = F.lit(True)
    for name in support:
        has = has & F.col(name).isNotNull()
    valid = F.col("dem").isNotNull()
    land = valid & F.coalesce(F.col("land"), F.lit(False))
    return cells.withColumns(dict(zip(DOMAINS, (valid, land, has, land & has, land & ~has))))


def mask_area(mask: DataFrame, grid: GridSpec, by: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """(*by, pixels, area_km2, ...) of the rows of ``mask``; each of ``more`` is a condition counted and measured too."""
    counts = [F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in more.items()]]
    rows = mask.groupBy(*by, "row").agg(*counts).join(small(row_area_table(mask.sparkSession, grid), grid.nrows), "row")
    sums = [F.sum("n").alias("pixels"), F.sum(F.col("n") * F.col("area_km2")).alias("area_km2")]
    sums += [F.sum(F.col(f"n_{k}") * F.col("area_km2")).alias(f"{k}_area_km2") for k in more]
    return rows.groupBy(*by).agg(*sums)


def domain_summary(cells: DataFrame, grid: GridSpec, support: tuple[str, ...] = ("rate", "sub_2100")) -> DataFrame:
    """(domain, pixels, area_km2, share_of_dem_land_percent) of the five domains, in one pass over the cells."""
    counts = domain_masks(cells, support).groupBy("row").agg(*[F.count_if(d).alias(d) for d in DOMAINS])
    rows = counts.join(small(row_area_table(cells.sparkSession, grid), grid.nrows), "row")
    one = rows.agg(*[F.struct(F.coalesce(F.sum(d), F.lit(0)).alias("pixels"), F.coalesce(F.sum(F.col(d) * F.col("area_km2")), F.lit(0.0)).alias("area_km2")).alias(d) for d in DOMAINS])
    each = F.inline(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d)["pixels"].alias("pixels"), F.col(d)["area_km2"].alias("area_km2")) for d in DOMAINS]))
    land = F.col("dem_valid_land")["area_km2"].alias("land_km2")
    return one.select(land, each).select("domain", "pixels", "area_km2", F.try_divide(F.col("area_km2") * 100.0, F.col("land_km2")).alias("share_of_dem_land_percent"))


def band_stats(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(band, valid_pixels, minimum, maximum) over valid cells."""
    one = cells.agg(*[F.struct(F.count(b).alias("valid_pixels"), F.min(b).cast("double").alias("minimum"), F.max(b).cast("double").alias("maximum")).alias(b) for b in bands])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b)["valid_pixels"].alias("valid_pixels"), F.col(b)["minimum"].alias("minimum"), F.col(b)["maximum"].alias("maximum")) for b in bands])))


def weighted_area(cells: DataFrame, fraction: str, grid: GridSpec, **masks: Column) -> DataFrame:
    """One row: for each mask the sum of fraction x row area over its cells."""
    sums = [F.sum(F.when(m, F.col(fraction).cast("double")).otherwise(0.0)).alias(k) for k, m in masks.items()]
    rows = cells.groupBy("row").agg(*sums).join(small(row_area_table(cells.sparkSession, grid), grid.nrows), "row")
    return rows.agg(*[F.coalesce(F.sum(F.col(k) * F.col("area_km2")), F.lit(0.0)).alias(k) for k in masks])


def representativeness(areas: DataFrame, built: DataFrame, people: DataFrame) -> DataFrame:
    """One row of shares of the common domain: land, built-up area, population. Each input is one row (total, common)."""
    out = areas
    for name, df in (("land", areas), ("built", built), ("population", people)):
        one = df.select(F.col("total").alias(f"{name}_total"), F.col("common").alias(f"{name}_common"), F.try_divide(F.col("common") * 100.0, F.col("total")).alias(f"{name}_share_percent"))
        out = one if name == "land" else out.crossJoin(one)
    return out
