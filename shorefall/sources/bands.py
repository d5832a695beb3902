"""Bands, scenario tables, population tables, polygons, masks, layers, reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..grid import GridSpec
from ..scratch import Scratch
from .digests import file_digests
from .features import feature_texts

MAIN_SCENARIOS, MAIN_YEARS, MAIN_ADDED = ("SSP2-4.5", "SSP5-8.5"), (2050, 2100), (0.0, 1.5, 3.0)
#: Columns that may name a unit, the first that exists is taken.
NAME_COLUMNS = ("NAME_2", "NL_NAME_2", "NAME_1", "GID_2", "GID_1")
#: Rows of a mask that go to one file.
MASK_ROWS = 512
SCENARIO_SCHEMA = "scenario string, year int, surge_m double, water_level_used_egm2008_m double"


def valid_value(v: Column, nodata: float | None = -9999.0) -> Column:
    """The value, or null where it is no data, NaN or infinite."""
    bad = F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    if nodata is not None:
        bad = bad | (v == F.lit(nodata).cast("float"))
    return F.when(~bad, v)


def load_band(spark: SparkSession, path: str, nodata: float | None = -9999.0) -> DataFrame:
    """(row, col, value) of a Parquet cell table; no data becomes null."""
    return spark.read.parquet(path).select("row", "col", valid_value(F.col("value").cast("float"), nodata).alias("value"))


def stack_bands(dem: DataFrame, bands: dict[str, DataFrame], by: tuple[str, ...] = ("row", "col"), parts: int | None = None) -> DataFrame:
    """Wide cells: the DEM's cells with one column a band; cells that a band lacks are null there.

    All bands meet in one grouping. With ``parts`` they are dealt in so many parts by the first column of ``by`` (a tile), and meet
    there, so that the result can be written in buckets as it lies. Bands must lie on the DEM's grid: a cell that the DEM lacks is an error when it is read. Of
    rows that repeat a cell in a band the largest value counts.
    """
    all_bands = {"dem": dem, **bands}
    rows = None
    for i, band in enumerate(all_bands.values()):
        own = band.select(*by, F.lit(i).alias("__band"), "value")
        rows = own if rows is None else rows.union(own)
    rows = rows.repartition(parts, by[0]) if parts else rows
    own = lambda i: F.col("__band") == i
    grouped = rows.groupBy(*by).agg(*[F.max(F.when(own(i), F.col("value"))).alias(n) for i, n in enumerate(all_bands)], F.max(own(0)).alias("__dem"), F.max("__band").alias("__last"))
    name = F.array(*[F.lit(n) for n in all_bands])[F.col("__last")]
    checked = F.when(F.col("__dem"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("band "), name, F.lit(" is not on the DEM's grid"))).cast("boolean"))
    return grouped.where(checked).drop("__dem", "__last")


def load_scenarios(
    spark: SparkSession, path: str, scenarios=MAIN_SCENARIOS, years=MAIN_YEARS, added=MAIN_ADDED, expected: int | None = 12
) -> DataFrame:
    """(scenario, year, added_water_m, water_level_egm2008_m) from CSV.

    Added water is compared after rounding to millimetres (halves to even); of rows with one key the first in
    the file counts (of several files the first by name). Another number of rows than expected is an error.
    """
    raw = spark.read.csv(path, header=True, schema=SCENARIO_SCHEMA).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("line"))
    kept = raw.where(F.col("scenario").isin(*scenarios) & F.col("year").isin(*years) & F.bround("surge_m", 3).isin(*added))
    first = F.min_by("water_level_used_egm2008_m", "line").alias("water_level_egm2008_m")
    out = kept.groupBy("scenario", "year", F.col("surge_m").alias("added_water_m")).agg(first)
    if expected is not None and (found := out.count()) != expected:
        raise ValueError(f"expected {expected} main scenarios, found {found}")
    return out.orderBy("scenario", "year", "added_water_m")


def select_population(files: DataFrame, scenario: str, year: int) -> DataFrame:
    """The one row of files (column path) that ends in <scenario>_<year>.tif or .parquet in any case; else an error."""
    found = files.where(F.lower(F.translate("path", "\\", "/")).rlike(f"{scenario}_{year}\\.(tif|parquet)$".lower()))
    n = len(found.limit(2).collect())
    if n != 1:
        raise ValueError(f"expected one grid of {scenario}_{year}, found {'none' if not n else 'several'}")
    return found


def load_admin_units(
    spark: SparkSession, path: str, bbox: tuple[float, float, float, float], names: tuple[str, ...] = NAME_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """(units, edges) of the features of GeoJSON files whose box meets bbox (west, east, south, north).

    The files are read in parts (``feature_texts``).
    units: unit_id, name. edges: unit_id, part, ring, x1, y1, x2, y2. Features without geometry go. The name is
    the first of ``names`` that the file has (by its columns, not row by row), else the feature's number.
    """
    rings = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    scratch = Scratch(spark)
    schema = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    read = feature_texts(spark, path, scratch).select(F.col("number").alias("unit_id"), F.from_json("text", schema).alias("f"))
    feature = scratch.save(read.where("f.type = 'Feature'"))
    named = feature.agg(*[F.coalesce(F.max(F.map_contains_key("f.properties", F.lit(n))), F.lit(False)) for n in names]).first() if names else []
    found = [n for n, there in zip(names, named) if there]
    text = F.col("f.geometry.coordinates")
    many = T.ArrayType(rings)
    shape = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, many)).otherwise(F.array(F.from_json(text, rings)))
    name_of = next((n for n in names if n in found), None)
    name = F.col("f.properties")[name_of] if name_of else F.col("unit_id").cast("string")
    units = feature.where("f.geometry is not null").select("unit_id", name.alias("name"), shape.alias("shape")).where("shape is not null and size(shape) > 0 and size(shape[0]) > 0")
    ring = units.select("unit_id", F.posexplode("shape").alias("part", "p")).select("unit_id", "part", F.posexplode("p").alias("ring", "r"))
    ends = ring.select("unit_id", "part", "ring", F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"))
    edges = ends.select("unit_id", "part", "ring", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))
    west, east, south, north = bbox
    box = edges.groupBy("unit_id").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    near = box.where((F.col("w") <= east) & (F.col("e") >= west) & (F.col("s") <= north) & (F.col("n") >= south)).select("unit_id")
    return units.join(near, "unit_id", "left_semi").select("unit_id", "name"), edges.join(near, "unit_id", "left_semi")


def write_masks(masks: DataFrame, path: str) -> None:
    """True cells of (case_id, label, row, col), one folder for each case and label, a mask in parts by blocks of rows."""
    masks.repartition("case_id", "label", F.floor(F.col("row") / MASK_ROWS)).write.mode("overwrite").partitionBy("case_id", "label").parquet(path)


def layer(cells: DataFrame, value: Column, inside: Column, nodata: float = -9999.0) -> DataFrame:
    """(row, col, value): 32-bit values inside a domain, no data outside it or where the value is null."""
    out = F.when(inside, value.cast("float"))
    return cells.select("row", "col", F.coalesce(out, F.lit(nodata).cast("float")).alias("value"))


def write_layer(cells: DataFrame, value: Column, inside: Column, path: str, nodata: float = -9999.0) -> None:
    layer(cells, value, inside, nodata).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Small result tables: one file. CSV is UTF-8 with a byte-order mark in front of the header."""
    one = df.coalesce(1)
    if fmt == "csv":
        marked = one.toDF("﻿" + df.columns[0], *df.columns[1:])
        marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        one.write.mode("overwrite").format(fmt).save(path)


def write_run_masks(runs: DataFrame, tags: DataFrame, path: str) -> None:
    """Masks as runs (case_id, label, row, start, stop), a folder for each case and label, and the tags of each case beside them.

    tags: a row for each case_id with what describes it (domain, connectivity, water level, persistence).
    """
    runs.repartition("case_id", "label", F.floor(F.col("row") / MASK_ROWS)).write.mode("overwrite").partitionBy("case_id", "label").parquet(f"{path}/runs")
    tags.coalesce(1).write.mode("overwrite").json(f"{path}/tags")


def read_run_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, tags) of ``write_run_masks``."""
    return spark.read.parquet(f"{path}/runs"), spark.read.json(f"{path}/tags")


def audit_report(summary: DataFrame, bands: DataFrame, shares: DataFrame, grid: GridSpec | None = None) -> DataFrame:
    """One nested row: band statistics, the domains, the shares of the common domain, and the grid of each band if it is given."""
    band = bands.agg(F.sort_array(F.collect_list(F.struct("band", "valid_pixels", "minimum", "maximum"))).alias("bands"))
    domains = summary.agg(F.sort_array(F.collect_list(F.struct("domain", "pixels", "area_km2", "share_of_dem_land_percent"))).alias("domains"))
    share = shares.select(F.struct(*shares.columns).alias("representativeness"))
    out = band.crossJoin(domains).crossJoin(share)
    if grid is None:
        return out
    geometry = F.struct(*[F.lit(v).alias(n) for n, v in _geometry(grid).items()])
    return out.withColumn("bands", F.transform("bands", lambda b: b.withField("grid", geometry)))


def _geometry(grid: GridSpec) -> dict:
    west, east, south, north = grid.extent()
    return {"crs": grid.crs, "width": grid.ncols, "height": grid.nrows, "west": west, "south": south, "east": east, "north": north, "pixel_width": grid.dx, "pixel_height": -grid.dy, "nodata": grid.nodata}


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, status): ok, mismatch (bytes or hash), missing (listed, not there), unlisted.

    files: file and content (binary or text), or file, bytes and sha256 as ``file_digests`` gives them for files of any size.
    manifest: file, bytes, sha256 (any case).
    """
    if "sha256" in files.columns:
        there = files.select("file", F.col("bytes").cast("long").alias("have_bytes"), F.lower("sha256").alias("have"))
    else:
        content = F.col("content").cast("binary")
        there = files.select("file", F.octet_length(content).cast("long").alias("have_bytes"), F.sha2(content, 256).alias("have"))
    both = there.join(manifest.select("file", F.col("bytes").cast("long").alias("bytes"), F.lower("sha256").alias("sha256")), "file", "full")
    status = (
        F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
        .when((F.col("have") == F.col("sha256")) & (F.col("have_bytes") == F.col("bytes")), "ok").otherwise("mismatch")
    )
    return both.select("file", status.alias("status"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of a folder's files of any size, for verify_manifest; file is the path from the folder."""
    return file_digests(spark, path)
