"""Geometry of north-up grids in one geographic CRS, and ellipsoidal cell areas."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: WGS 84
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
ECCENTRICITY_2 = FLATTENING * (2 - FLATTENING)


@dataclass(frozen=True)
class GridSpec:
    """x0, y0: the upper left corner; dx > 0, dy < 0: degrees a column and a row."""

    x0: float
    dx: float
    y0: float
    dy: float
    nrows: int
    ncols: int
    nodata: float = -9999.0
    crs: str = "EPSG:4326"

    def __post_init__(self):
        if not (self.dx > 0 > self.dy):
            raise ValueError("grids must be north-up: dx > 0 and dy < 0")

    def check_same_crs(self, other: "GridSpec") -> None:
        if self.crs != other.crs:
            raise ValueError(f"grids must share one CRS: {self.crs}, {other.crs}")

    def extent(self) -> tuple[float, float, float, float]:
        """west, east, south, north"""
        return self.x0, self.x0 + self.dx * self.ncols, self.y0 + self.dy * self.nrows, self.y0

    def lon(self, col: Column) -> Column:
        return F.lit(self.x0) + F.lit(self.dx) * (col + 0.5)

    def lat(self, row: Column) -> Column:
        return F.lit(self.y0) + F.lit(self.dy) * (row + 0.5)


def strip_area(latitude: Column) -> Column:
    """Integral of the ellipsoid's surface from the equator to a latitude (radians), per radian of longitude, in a^2."""
    e = math.sqrt(ECCENTRICITY_2)
    s = F.sin(latitude)
    return (1 - ECCENTRICITY_2) * (s / (2 * (1 - ECCENTRICITY_2 * s * s)) + F.atanh(e * s) / (2 * e))


def row_area_table(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """(row, area_km2) of one cell in each row."""
    edge = lambda r: F.radians(F.lit(grid.y0) + F.lit(grid.dy) * r)
    r = F.col("id")
    width = SEMI_MAJOR_M**2 * abs(math.radians(grid.dx)) / 1e6
    area = F.abs(strip_area(edge(r + 1)) - strip_area(edge(r))) * width
    return spark.range(grid.nrows).select(r.cast("int").alias("row"), area.alias("area_km2"))


def clip_window(grid: GridSpec, west: float, east: float, south: float, north: float) -> tuple[int, int, int, int]:
    """row0, row1, col0, col1 (ends excluded) of the cells that an extent touches, inside the grid."""
    col0 = max(0, math.floor((west - grid.x0) / grid.dx))
    col1 = min(grid.ncols, math.ceil((east - grid.x0) / grid.dx))
    row0 = max(0, math.floor((north - grid.y0) / grid.dy))
    row1 = min(grid.nrows, math.ceil((south - grid.y0) / grid.dy))
    if col1 <= col0 or row1 <= row0:
        raise ValueError("the extent does not overlap the grid")
    return row0, row1, col0, col1


def clip_extent(cells: DataFrame, grid: GridSpec, west: float, east: float, south: float, north: float) -> DataFrame:
    """Cells inside the window; plain range filters, so they reach the scan."""
    row0, row1, col0, col1 = clip_window(grid, west, east, south, north)
    return cells.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1))
