"""A store of cells by tile: written once in buckets, sorted by tile, row and column.

Work that groups by tile reads it without a shuffle, whatever its number of passes; a clip opens only the buckets of its tiles
and skips row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridSpec, clip_window
from .bands import stack_bands

TILE = 512
#: Tiles that a clip names one by one, so that other buckets are not opened.
NAMED_TILES = 4096


def tile_number(grid: GridSpec, tile: int = TILE) -> Column:
    across = -(-grid.ncols // tile)
    return (F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).cast("long")


def write_tiles(cells: DataFrame, grid: GridSpec, name: str, tile: int = TILE, parts: int | None = None, path: str | None = None) -> None:
    """A table of the catalogue with the cells and their tile. parts: buckets, by default as many as a shuffle has parts.

    A bucket is read by one task, so choose parts for the size of the table. With a path the files lie there.
    """
    parts = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cells.withColumn("tile", tile_number(grid, tile)).repartition(parts, "tile").write
    out = out.mode("overwrite").bucketBy(parts, "tile").sortBy("tile", "row", "col").option("compression", "zstd")
    (out.option("path", path) if path else out).saveAsTable(name)


def write_stack(dem: DataFrame, bands: dict[str, DataFrame], grid: GridSpec, name: str, tile: int = TILE, parts: int | None = None, path: str | None = None) -> None:
    """A store of the cells of ``stack_bands``. All bands are dealt to the buckets together, in one shuffle, and meet in them."""
    parts = parts or int(dem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stacked(dem, bands, grid, tile, parts).write
    out = out.mode("overwrite").bucketBy(parts, "tile").sortBy("tile", "row", "col").option("compression", "zstd")
    (out.option("path", path) if path else out).saveAsTable(name)


def stacked(dem: DataFrame, bands: dict[str, DataFrame], grid: GridSpec, tile: int, parts: int) -> DataFrame:
    """The stack with its tiles, in ``parts`` parts by tile."""
    number = tile_number(grid, tile)
    return stack_bands(dem.withColumn("tile", number), {n: b.withColumn("tile", number) for n, b in bands.items()}, ("tile", "row", "col"), parts)


def read_tiles(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def clip_tiles(cells: DataFrame, grid: GridSpec, west: float, east: float, south: float, north: float, tile: int = TILE) -> DataFrame:
    """Cells of a store inside an extent."""
    row0, row1, col0, col1 = clip_window(grid, west, east, south, north)
    across = -(-grid.ncols // tile)
    rows, cols = range(row0 // tile, (row1 - 1) // tile + 1), range(col0 // tile, (col1 - 1) // tile + 1)
    if len(rows) * len(cols) <= NAMED_TILES:
        cells = cells.where(F.col("tile").isin([r * across + c for r in rows for c in cols]))
    return cells.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1))
