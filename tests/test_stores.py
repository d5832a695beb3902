"""Tile store, runs, halo windows, split GeoJSON and digests of large files."""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.grid import GridSpec
from shorefall.operators import runs
from shorefall.operators.areas import mask_area
from shorefall.operators.flood import Case, connected_flood, edge_cells
from shorefall.operators.halo import window
from shorefall.operators.resample import overlap_fraction
from shorefall.operators.spill import flood_by_levels, flood_runs, same_masks
from shorefall.plans.sites import site_trend
from shorefall.scratch import Scratch
from shorefall.sources import bands, features, store
from shorefall.sources.digests import file_digests


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    grid = GridSpec(0, 1, 0, -1, 60, 90)
    cells = spark.range(60 * 90).select((F.col("id") / 90).cast("int").alias("row"), (F.col("id") % 90).cast("int").alias("col"))
    cells = cells.withColumn("dem", (F.pmod(F.xxhash64("row", "col"), F.lit(100)) / 20).cast("float")).withColumn("land", F.col("col") > 3)
    store.write_tiles(cells, grid, "tiles_of_test", tile=16, parts=8, path=str(tmp_path_factory.mktemp("store") / "tiles"))
    yield spark.table("tiles_of_test"), cells, grid
    spark.sql("drop table tiles_of_test")


def test_floods_scan_a_store_without_an_exchange(stored):
    tiles, cells, grid = stored
    cases = [Case("dem", 2.0), Case("dem", 3.5, 4)]
    for how in (connected_flood, flood_by_levels):
        out = how(tiles, grid, {"dem": F.col("dem")}, cases, tile=16, stored=True)
        plan = plan_of(out)
        assert plan[plan.index("FlatMapCoGroups") :].count("Exchange") == 1  # of the border, not of the cells
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, how(cells, grid, {"dem": F.col("dem")}, cases, tile=512).collect()))
    outline = plan_of(tiles.groupBy("tile").applyInArrow(lambda t: t, tiles.schema))
    assert "Exchange" not in outline and "Bucketed: true" in outline


def test_a_stack_is_dealt_once_and_scanned_without_an_exchange(spark, stored, tmp_path):
    _, cells, grid = stored
    band = lambda v: cells.select("row", "col", v.alias("value"))
    each = {"twice": band(F.col("dem") * 2), "some": band(F.col("dem")).where("row % 3 = 0")}
    assert plan_of(store.stacked(band(F.col("dem")), each, grid, 16, 8)).count("Exchange") == 1
    store.write_stack(band(F.col("dem")), each, grid, "stack_of_test", 16, 8, str(tmp_path / "stack"))
    out = store.read_tiles(spark, "stack_of_test")
    assert "Exchange" not in plan_of(out) and "Exchange" not in plan_of(out.groupBy("tile", "row").agg(F.max("dem")))
    got = {(r.row, r.col): (r.dem, r.twice, r.some) for r in out.collect()}
    assert got == {(r.row, r.col): (r.dem, r.dem * 2, r.dem if r.row % 3 == 0 else None) for r in cells.collect()}
    assert len(list((tmp_path / "stack").glob("*.parquet"))) <= 8
    spark.sql("drop table stack_of_test")


def test_stray_bands_are_refused(spark):
    dem = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value float")
    stray = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "row int, col int, value float")
    with pytest.raises(Exception, match="band rate is not on the DEM's grid"):
        bands.stack_bands(dem, {"rate": stray}).collect()
    assert [tuple(r) for r in bands.stack_bands(dem, {"rate": dem}).collect()] == [(0, 0, 1.0, 1.0)]


def test_a_clip_asks_the_scan_for_its_tiles_and_rows(stored):
    tiles, cells, grid = stored
    out = store.clip_tiles(tiles, grid, 17, 30, -30, -17, tile=16)
    plan = plan_of(out)
    assert "Exchange hash" not in plan and "EqualTo(tile,7)" in plan and "GreaterThanOrEqual(row,17)" in plan
    want = {(r.row, r.col) for r in cells.collect() if 17 <= r.row < 30 and 17 <= r.col < 30}
    assert {(r.row, r.col) for r in out.collect()} == want


# --- runs and halos


def test_runs_give_areas_and_overlaps_of_cells(spark):
    rng = np.random.default_rng(3)
    src, dst = GridSpec(112, 0.0005, 22.8, -0.0005, 40, 70), GridSpec(112.0003, 0.0014, 22.7996, -0.0014, 14, 24)
    cells = spark.createDataFrame([(int(k), int(r), int(c)) for k in range(3) for r, c in zip(*np.nonzero(rng.random((40, 70)) < 0.2 + 0.3 * k))] + [(0, 0, 0)] * 2, "mask int, row int, col int")
    own = runs.cells_to_runs(cells, ("mask",))
    assert sorted(map(tuple, runs.runs_to_cells(own).select("mask", "row", "col").collect())) == sorted({tuple(r) for r in cells.collect()})
    close = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    by = lambda df, *k: {tuple(r[c] for c in k): r[-1] for r in df.collect()}
    assert close(by(runs.run_area(own, src), "mask", "pixels"), by(mask_area(cells.distinct(), src, ("mask",)), "mask", "pixels"))
    assert close(by(runs.run_overlap(own, src, dst), "mask", "drow", "dcol"), by(overlap_fraction(cells.distinct(), src, dst, ("mask",)), "mask", "drow", "dcol"))
    assert runs.cells_to_runs(cells.limit(0)).collect() == []


def test_flood_runs_are_the_flood(spark, stored):
    _, cells, grid = stored
    cells = cells.withColumn("common", F.col("row") % 5 > 0)
    cases = [Case("dem", 2.0), Case("dem", 3.5), Case("up", 3.5, 4)]
    surfaces = {"dem": F.col("dem"), "up": F.col("dem") + F.lit(0.25).cast("float")}
    less = [(1, 0), (1, 2)]
    got = {(r["mask"], r.row, r.col) for r in runs.runs_to_cells(flood_runs(cells, grid, surfaces, cases, less, "common", tile=16)).collect()}
    hits = {(r.row, r.col): set(r.hits) for r in connected_flood(cells, grid, surfaces, cases, carry=("common",)).where("common").collect()}
    want = {(k, *p) for p, h in hits.items() for k in h} | {(3 + i, *p) for p, h in hits.items() for i, (a, b) in enumerate(less) if a in h and b not in h}
    assert got == want


def test_same_masks(spark):
    cells = spark.createDataFrame([(1.0, True), (2.0, True), (None, True), (2.2, False)], "dem float, land boolean")
    surfaces = {"dem": F.col("dem"), "up": F.col("dem") + F.lit(0.5).cast("float")}
    assert same_masks(cells, surfaces, [(("up", 2.0), ("dem", 1.5)), (("up", 2.5), ("dem", 1.9)), (("up", 9.0), ("dem", 9.0))]) == [True, False, True]


@pytest.mark.parametrize("tile", [1, 3, 16, 512])
def test_halo_windows(spark, tile):
    rng = np.random.default_rng(tile)
    n, m = 9, 20
    there = rng.random((n, m)) < 0.8
    values = rng.integers(0, 9, (n, m)).astype(float)
    cells = spark.createDataFrame([(int(r), int(c), float(values[r, c])) for r, c in zip(*np.nonzero(there))], "row int, col int, v double")
    padded = np.pad(np.where(there, values, 0.0), 1)
    want = sum(padded[a : a + n, b : b + m] for a in range(3) for b in range(3))
    got = {(r.row, r.col): r.value for r in window(cells, {"v": 0.0}, lambda v: sum(v[a : v.shape[0] - 2 + a, b : v.shape[1] - 2 + b] for a in range(3) for b in range(3)), "double", tile=tile).collect()}
    assert got == {(int(r), int(c)): want[r, c] for r, c in zip(*np.nonzero(there))}
    whole = np.pad(there, 1)
    around = sum(whole[a : a + n, b : b + m].astype(int) for a in range(3) for b in range(3))
    assert {(r.row, r.col) for r in edge_cells(cells, tile=tile).collect()} == {(int(r), int(c)) for r, c in zip(*np.nonzero(there & (around < 9)))}


def test_a_halo_shuffles_rims_alone(spark):
    cells = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.lit(1.0).alias("v"))
    out = window(cells, {"v": 0.0}, lambda v: v[1:-1, 1:-1], "double", tile=32)
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning(tile") == 1 and "Generate explode" in plan[plan.index("Exchange hashpartitioning(tile") :]
    with pytest.raises(ValueError):
        window(cells, {"v": 0.0}, lambda v: v, "double", reach=3, tile=2)


# --- least squares


@pytest.mark.parametrize("first", [0.0, 2015.0, 1e6])
def test_trend_of_calendar_years(spark, first):
    rows = [(s, first + k, 3 + 2 * k + 0.5 * k * k + s) for s in (0, 1) for k in range(10)] + [(2, first, 1.0), (2, first + 1, 2.0), (3, None, 1.0), (3, first, float("nan")), (4, first, 2.0), (4, first, 3.0)]
    got = {r.site: r for r in site_trend(spark.createDataFrame(rows, "site int, t double, y double"), origin=first).collect()}
    for s in (0, 1):
        assert [got[s].c0, got[s].c1, got[s].c2] == pytest.approx([3 + s, 2, 0.5], abs=1e-9) and got[s].n == 10
    assert got[2].c2 is None and 3 not in got and (got[4].n, got[4].c0) == (2, None)


# --- features


def collection(n, many=False):
    feats = []
    for i in range(n):
        ring = [[i + 0.0, 0.0], [i + 0.5, 0.0], [i + 0.5, 0.5], [i + 0.0, 0.0]]
        shape = {"type": "MultiPolygon", "coordinates": [[ring], [ring]]} if many and i % 2 else {"type": "Polygon", "coordinates": [ring]}
        odd = ['br{ace', "quo\\\"te}", 'back\\slash\\', "Feature", ""][i % 5]
        feats.append({"id": i, "properties": {"NAME_1": f"n{i}{odd}", "deep": {"a": [{"b": "}"}]}}, "geometry": shape if i % 7 else None, "type": "Feature"})
    return {"type": "FeatureCollection", "name": "x [ { \" ", "crs": {"type": "name", "properties": {"name": "y"}}, "features": feats}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [1499, 1 << 27])
def test_features_are_cut_anywhere(spark, tmp_path, split, indent):
    made = [collection(40), collection(23, True)]
    for i, c in enumerate(made):
        (tmp_path / f"f{i}.json").write_text(json.dumps(c, indent=indent) + "\n" * i)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = [(r.number, json.loads(r.text)) for r in features.feature_texts(spark, str(tmp_path), Scratch(spark)).orderBy("number").collect()]
        units, edges = bands.load_admin_units(spark, str(tmp_path), (-1, 1000, -1, 1))
        names = {r.name for r in units.collect()}
        n_edges = edges.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had[0])
        spark.conf.set("spark.sql.files.openCostInBytes", had[1])
    assert [n for n, _ in got] == list(range(len(got)))
    assert [x for _, x in got if x["type"] == "Feature"] == [f for c in made for f in c["features"]]
    shown = [f for c in made for f in c["features"] if f["geometry"]]
    assert names == {f["properties"]["NAME_1"] for f in shown}
    assert n_edges == sum(3 * (2 if f["geometry"]["type"] == "MultiPolygon" else 1) for f in shown)


def test_many_polygons_load_in_parts(spark, tmp_path):
    ring = "[[%d.0, 0.0], [%d.5, 0.0], [%d.5, 0.5], [%d.0, 0.0]]"
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        f.write(", ".join('{"type": "Feature", "properties": {"GID_1": "g%d"}, "geometry": {"type": "Polygon", "coordinates": [' % i + ring % (i, i, i, i) + "]}}" for i in range(100_000)))
        f.write("]}")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
        assert features._pieces(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 8
        units, edges = bands.load_admin_units(spark, str(tmp_path), (-1, 1e6, -1, 1))
        assert units.agg(F.count_distinct("name")).first()[0] == 100_000 and edges.count() == 300_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


# --- digests


def test_digests_of_files_in_folders(spark, tmp_path):
    want = {}
    for name in ("a/same.bin", "b/same.bin", "c.txt", "empty"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode() * (0 if name == "empty" else 1000))
        want[name] = (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest())
    found = file_digests(spark, str(tmp_path))
    assert {r.file: (r.bytes, r.sha256) for r in found.collect()} == want
    listed = [(n, b, h.upper()) for n, (b, h) in want.items() if n != "c.txt"] + [("gone", 1, "0")]
    listed[1] = ("b/same.bin", listed[1][1], "f" * 64)
    status = {r.file: r.status for r in bands.verify_manifest(bands.read_files(spark, f"file://{tmp_path}"), spark.createDataFrame(listed, "file string, bytes long, sha256 string")).collect()}
    assert status == {"a/same.bin": "ok", "b/same.bin": "mismatch", "c.txt": "unlisted", "empty": "ok", "gone": "missing"}


CHILD = """
import resource, sys
from shorefall.sources.digests import _Reader
r = _Reader(sys.argv[1])
for part in r.partitions():
    for name, size, sha in r.read(part):
        print(name, size, sha, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_a_large_file_is_read_in_blocks(tmp_path):
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(3 << 30)
    name, size, sha, kb = subprocess.run([sys.executable, "-c", CHILD, str(tmp_path)], capture_output=True, text=True, check=True).stdout.split()
    want = hashlib.sha256()
    for _ in range(3 << 6):
        want.update(bytes(1 << 24))
    assert (name, int(size), sha) == ("sparse", 3 << 30, want.hexdigest()) and int(kb) < 500_000


# --- blocks


@pytest.mark.parametrize("block", [4, 16, 64])
def test_coverage_from_block_sums(spark, block):
    from shorefall.operators import zones

    rng = np.random.default_rng(block)
    n, m = 50, 70
    grid = GridSpec(112, 0.0005, 22.8, -0.0005, n, m)
    kind = rng.random((n, m))
    rows = [(r, c, 1.0 if kind[r, c] > 0.1 else None, bool(kind[r, c] > 0.3), 1.0 if kind[r, c] > 0.5 else None, 1.0) for r in range(n) for c in range(m)]
    cells = spark.createDataFrame(rows, "row int, col int, dem float, land boolean, rate float, sub_2100 float")
    spans = [(u, r, a, b) for u, (r0, r1, lean) in enumerate([(0, 50, 0), (3, 45, 1), (10, 12, 0), (49, 50, 0)]) for r in range(r0, r1) for a, b in [(min(69, lean * r // 2), 69 - lean * r // 3)]]
    spans += [(4, 5, 3, 3), (4, 5, 60, 62)]
    got = {x.administrative_unit: (x.land_area_km2, x.common_area_km2) for x in zones.admin_coverage(spark.createDataFrame([(u, f"u{u}") for u in range(6)], "unit_id int, name string"), spark.createDataFrame(spans, "unit_id int, row int, col_start int, col_end int"), cells, grid, block=block).collect()}
    from shorefall.grid import row_area_table

    area = {r.row: r.area_km2 for r in row_area_table(spark, grid).collect()}
    want = {}
    for u, r, a, b in spans:
        for c in range(a, b + 1):
            if kind[r, c] > 0.3:
                x, y = want.get(f"u{u}", (0.0, 0.0))
                want[f"u{u}"] = (x + area[r], y + area[r] * (kind[r, c] > 0.5))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest_value_against_all_cells(spark):
    from shorefall.operators import zones

    rng = np.random.default_rng(4)
    n, m, block = 60, 90, 4
    grid = GridSpec(20, 0.01, 61, -0.01, n, m)
    there = rng.random((n, m)) < 0.004
    there[50, 80:84] = True
    cells = spark.createDataFrame([(r, c, float(r) if there[r, c] else None) for r in range(n) for c in range(m)], "row int, col int, dem float")
    sites = [(i, float(20 + rng.random() * 0.9), float(61 - rng.random() * 0.6)) for i in range(1000)] + [(1000, 19.0, 61.5), (1001, 25.0, 60.0), (1002, None, 60.0)]
    sites += [(1003, 20 + 0.01 * 82.0, 61 - 0.01 * 50.5)]  # as far from one cell as from the next
    got = {x.site: (x.row, x.col, x.value) for x in zones.nearest_value(spark.createDataFrame(sites, "site int, lon double, lat double"), cells, grid, block=block).collect()}
    r, c = np.nonzero(there)
    lat, lon = np.radians(61 - 0.01 * (r + 0.5)), np.radians(20 + 0.01 * (c + 0.5))
    for i, x, y in sites:
        if x is None:
            assert i not in got
            continue
        a, b = np.radians(y), np.radians(x)
        d = np.round(2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2)), 6)
        k = np.lexsort((c, r, d))[0]
        assert got[i] == (r[k], c[k], float(r[k])), i
    assert zones.nearest_value(spark.createDataFrame(sites, "site int, lon double, lat double"), cells.where("dem > 1000"), grid).collect() == []
