"""Polygons on a grid by scanlines, and what lies in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridSpec, row_area_table
from ..scratch import Scratch
from .areas import domain_masks
from .resample import small


def cells_in_units(edges: DataFrame, grid: GridSpec) -> DataFrame:
    """(unit_id, row, col_start, col_end): spans, both ends included, of cells whose centre lies in a unit (even-odd).

    edges: unit_id, x1, y1, x2, y2. An edge holds centres in [lower y, upper y), so a shared vertex counts once.
    Edges are multiplied by grid rows, never by cells.
    """
    line = lambda y: (F.col(y) - grid.y0) / grid.dy - 0.5
    high, low = F.least(line("y1"), line("y2")), F.greatest(line("y1"), line("y2"))
    first, last = F.greatest(F.floor(high) + 1, F.lit(0)), F.least(F.floor(low), F.lit(grid.nrows - 1))
    rows = edges.select("*", first.cast("int").alias("r0"), last.cast("int").alias("r1")).where("r0 <= r1 and y1 <> y2")
    rows = rows.select("unit_id", "x1", "y1", "x2", "y2", F.explode(F.sequence("r0", "r1")).alias("row"))
    y = F.lit(grid.y0) + F.lit(grid.dy) * (F.col("row") + 0.5)
    crossing = rows.select("unit_id", "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    w = Window.partitionBy("unit_id", "row").orderBy("x")
    pairs = crossing.select("unit_id", "row", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("n")).where("n % 2 = 1 and to is not null")
    col = lambda x: F.ceil((F.col(x) - grid.x0) / grid.dx - 0.5)
    spans = pairs.select("unit_id", "row", F.greatest(col("x"), F.lit(0)).cast("int").alias("col_start"), F.least(col("to") - 1, F.lit(grid.ncols - 1)).cast("int").alias("col_end"))
    return spans.where("col_start <= col_end")


#: Cells on a side of the blocks whose sums stand for cells where a unit covers them.
BLOCK = 64


def _covered(own: pa.Table, spans: pa.Table, block: int) -> pa.Table:
    """(unit_id, land_km2, common_km2, land_cells): a block's sums under the spans that cover a part of it."""
    names, kinds = ["unit_id", "land_km2", "common_km2", "land_cells"], [spans.schema.field("unit_id").type, pa.float64(), pa.float64(), pa.int64()]
    if not own.num_rows or not spans.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    row, col = (own.column(c).to_numpy() for c in ("row", "col"))
    row0, col0 = row.min() // block * block, col.min() // block * block
    r, first, last = (spans.column(c).to_numpy() for c in ("row", "first", "last"))
    sums = []
    for value in (own.column("land_km2"), own.column("common_km2"), own.column("land_cells")):
        dense = np.zeros((block, block + 1), value.to_numpy().dtype)
        dense[row - row0, col - col0 + 1] = value.to_numpy()
        along = np.cumsum(dense, axis=1)
        sums.append(along[r - row0, last - col0 + 1] - along[r - row0, first - col0])
    out = pa.table([spans.column("unit_id"), *map(pa.array, sums)], names).group_by("unit_id").aggregate([(n, "sum") for n in names[1:]])
    return out.select(["unit_id", *[f"{n}_sum" for n in names[1:]]]).rename_columns(names)


def admin_coverage(units: DataFrame, spans: DataFrame, cells: DataFrame, grid: GridSpec, layer: str = "ADM_2", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(administrative_unit, gadm_layer, land_area_km2, common_area_km2, common_share_percent); units without land go.

    A unit asks for the sums of blocks that it covers, and for cells only in the blocks along its edge, where running
    sums inside the block answer its spans. Cells are dealt to blocks once, without a window over them.
    """
    scratch = scratch or Scratch(cells.sparkSession)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda row, col: F.shiftleft(F.floor(row / block), 32).bitwiseOR(F.floor(col / block))
    land, common, km2 = F.col("dem_valid_land"), F.col("common_analysis_land"), F.col("area_km2")
    marked = domain_masks(cells).where(land).select("row", "col", land, common).join(small(row_area_table(cells.sparkSession, grid), grid.nrows), "row")
    valued = marked.select(number(F.col("row"), F.col("col")).alias("tile"), "row", "col", km2.alias("land_km2"), F.when(common, km2).otherwise(0.0).alias("common_km2"), F.lit(1).cast("long").alias("land_cells"))
    dealt = scratch.save_by(valued, "tile", parts)
    whole = dealt.groupBy("tile").agg(*[F.sum(c).alias(c) for c in ("land_km2", "common_km2", "land_cells")])
    # spans cut at blocks, and the blocks that all cells of a unit fill
    c = F.explode(F.sequence(F.floor(F.col("col_start") / block), F.floor(F.col("col_end") / block))).alias("c")
    pieces = spans.select("unit_id", "row", "col_start", "col_end", c)
    pieces = scratch.save(pieces.select("unit_id", "row", number(F.col("row"), F.col("c") * block).alias("tile"), F.greatest("col_start", F.col("c") * block).cast("int").alias("first"), F.least("col_end", (F.col("c") + 1) * block - 1).cast("int").alias("last")))
    held = pieces.groupBy("unit_id", "tile").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    top, left = F.shiftright("tile", 32) * block, F.col("tile").bitwiseAND(F.lit((1 << 32) - 1)) * block
    size = (F.least(top + block, F.lit(grid.nrows)) - top) * (F.least(left + block, F.lit(grid.ncols)) - left)
    held = scratch.save(held.select("unit_id", "tile", (F.col("n") == size).alias("full")))
    inner = held.where("full").join(whole, "tile").select("unit_id", "land_km2", "common_km2", "land_cells")
    edge = pieces.join(held.where("not full").select("unit_id", "tile"), ["unit_id", "tile"], "left_semi")
    unit = spans.schema["unit_id"].dataType.simpleString()
    partial = dealt.groupBy("tile").cogroup(edge.groupBy("tile")).applyInArrow(lambda a, b: _covered(a, b, block), f"unit_id {unit}, land_km2 double, common_km2 double, land_cells long")
    sums = inner.union(partial).groupBy("unit_id").agg(F.sum("land_km2").alias("land_area_km2"), F.sum("common_km2").alias("common_area_km2"), F.sum("land_cells").alias("n"))
    share = (F.col("common_area_km2") * 100.0 / F.col("land_area_km2")).alias("common_share_percent")
    out = sums.where("n > 0").join(units.select("unit_id", "name"), "unit_id")
    return out.select(F.col("name").alias("administrative_unit"), F.lit(layer).alias("gadm_layer"), "land_area_km2", "common_area_km2", share)


def top_units(coverage: DataFrame, k: int = 6, min_area: float = 1.0) -> DataFrame:
    """The k units with the largest common area above a limit, smallest first."""
    return coverage.where(F.col("common_area_km2") > min_area).orderBy(F.desc("common_area_km2"), "administrative_unit").limit(k).orderBy("common_area_km2", "administrative_unit")


def nearest_pixel(sites: DataFrame, cells: DataFrame, grid: GridSpec, band: str = "dem") -> DataFrame:
    """Columns of sites with row, col of the cell that holds each, great-circle distance to its centre (m), and its value.

    A site on a cell of no data, or off the grid, gets a null value.
    """
    radius = 6371008.8
    row, col = F.floor((F.col("lat") - grid.y0) / grid.dy).cast("int"), F.floor((F.col("lon") - grid.x0) / grid.dx).cast("int")
    at = sites.withColumns({"row": row, "col": col})
    a, b = F.radians("lat"), F.radians(grid.lat(F.col("row")))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(grid.lon(F.col("col")) - F.col("lon")) / 2), 2)
    return at.withColumn("distance_m", 2 * radius * F.asin(F.sqrt(h))).join(cells.select("row", "col", F.col(band).alias("value")), ["row", "col"], "left")


#: Cells on a side of the blocks that a search for values goes through, ring by ring.
SEARCH_BLOCK = 32


def _distance(grid: GridSpec, lat, lon, row, col):
    """Great-circle distance from a place to a cell's centre in m, to a micrometre, so that equal ones are equal."""
    a, b = F.radians(lat), F.radians(grid.lat(row))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(grid.lon(col) - lon) / 2), 2)
    return F.round(2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))), 6)


def nearest_value(sites: DataFrame, cells: DataFrame, grid: GridSpec, band: str = "dem", block: int = SEARCH_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(site, row, col, distance_m, value): the cell with a value whose centre is nearest to each site, ties to the smaller row, then column.

    sites: site (unique), lon, lat. Cells with a value lie in buckets by block. In each round a site looks into the blocks of the next rings around
    its own, twice as many as before; it is done when no cell beyond the rings can be as near as what it has. So a site
    costs the blocks up to its answer, and the number of rounds is the logarithm of the farthest answer. A table
    without values leaves sites without rows; sites with a null place have none.
    """
    spark = sites.sparkSession
    scratch = scratch or Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row, col = F.floor((F.col("lat") - grid.y0) / grid.dy).cast("int"), F.floor((F.col("lon") - grid.x0) / grid.dx).cast("int")
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    home = sites.select("site", "lon", "lat", F.floor(inside(row, grid.nrows) / block).alias("br"), F.floor(inside(col, grid.ncols) / block).alias("bc"), row.alias("own_row"), col.alias("own_col")).where("lon is not null and lat is not null")
    number = lambda r, c: F.shiftleft(r, 32).bitwiseOR(c)
    values = cells.where(F.col(band).isNotNull()).select(number(F.floor(F.col("row") / block), F.floor(F.col("col") / block)).alias("tile"), "row", "col", F.col(band).alias("value"))
    values = scratch.save_by(values, "tile", parts)
    blocks = scratch.save(values.select("tile").distinct())
    most = max(-(-grid.nrows // block), -(-grid.ncols // block))
    best, open_, low, high = None, scratch.save(home), 0, 1
    if blocks.isEmpty():
        return home.select("site").join(values.select("row", "col", F.lit(0.0).alias("distance_m"), "value"), F.lit(False))
    while low <= most and not open_.isEmpty():
        # rings low to high - 1 around each site's block, inside the grid
        r0, r1 = F.greatest(F.col("br") - (high - 1), F.lit(0)), F.least(F.col("br") + (high - 1), F.lit(-(-grid.nrows // block) - 1))
        c0, c1 = F.greatest(F.col("bc") - (high - 1), F.lit(0)), F.least(F.col("bc") + (high - 1), F.lit(-(-grid.ncols // block) - 1))
        asked = open_.where((r0 <= r1) & (c0 <= c1)).select("*", F.explode(F.sequence(r0, r1)).alias("r")).select("*", F.explode(F.sequence(c0, c1)).alias("c"))
        asked = asked.where(F.greatest(F.abs(F.col("r") - F.col("br")), F.abs(F.col("c") - F.col("bc"))) >= low).select("site", "lon", "lat", number(F.col("r"), F.col("c")).alias("tile"))
        asked = asked.join(blocks, "tile", "left_semi")
        seen = asked.join(values, "tile").withColumn("distance_m", _distance(grid, F.col("lat"), F.col("lon"), F.col("row"), F.col("col")))
        seen = seen.groupBy("site").agg(F.min(F.struct("distance_m", "row", "col", "value")).alias("m"))
        seen = seen if best is None else seen.union(best).groupBy("site").agg(F.min("m").alias("m"))
        best = scratch.save(seen)
        # cells beyond the rings are so many rows or columns away at least; on a side where the grid ends there are none
        none = F.lit(float("inf"))

        def edge(at, b, n):
            low_side = F.when(F.col(b) - (high - 1) <= 0, none).otherwise(F.col(at) - (F.col(b) - (high - 1)) * block)  # noqa: B023
            high_side = F.when(F.col(b) + high >= -(-n // block), none).otherwise((F.col(b) + high) * block - 1 - F.col(at))  # noqa: B023
            return F.least(low_side, high_side).cast("double")

        rows, cols = edge("own_row", "br", grid.nrows), edge("own_col", "bc", grid.ncols)
        # the way to another meridian is shortest along the circle that meets it at a right angle
        across = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(cols * grid.dx, F.lit(90.0)))))
        beyond = F.least(F.when(rows == none, none).otherwise(F.radians(rows * abs(grid.dy))), F.when(cols == none, none).otherwise(across)) * 6371008.8
        done = best.select("site", F.col("m.distance_m").alias("d"))
        still = open_.join(done, "site", "left").where(F.col("d").isNull() | (F.col("d") >= beyond)).drop("d")
        open_, low, high = scratch.save(still), high, 2 * high
    return best.select("site", "m.row", "m.col", "m.distance_m", "m.value")
