"""Small cases of readers, zones, resampling and column functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.functions import levels as lv
from shorefall.grid import GridSpec, clip_window, row_area_table
from shorefall.operators import areas, resample, zones
from shorefall.plans import priority as pr
from shorefall.plans import sites as st
from shorefall.sources import bands


def test_row_area_of_the_published_grid(spark):
    # a published total for a 2991 x 4874 grid of this geometry would need its exact transform; a sphere bounds it
    got = row_area_table(spark, GridSpec(112.0, 0.0005, 22.8, -0.0005, 4, 4)).collect()
    assert len(got) == 4 and all(0.0026 < r.area_km2 < 0.0029 for r in got)
    assert sorted(r.area_km2 for r in got) == [r.area_km2 for r in sorted(got, key=lambda r: r.row)]  # wider to the south


def test_grid_rules():
    with pytest.raises(ValueError):
        GridSpec(0, 1, 0, 1, 2, 2)
    with pytest.raises(ValueError):
        GridSpec(0, 1, 0, -1, 2, 2).check_same_crs(GridSpec(0, 1, 0, -1, 2, 2, crs="EPSG:3857"))
    assert clip_window(GridSpec(0, 1, 0, -1, 4, 4), 0.5, 2.0, -2.5, -1.0) == (1, 3, 0, 2)
    with pytest.raises(ValueError):
        clip_window(GridSpec(0, 1, 0, -1, 4, 4), 5, 6, -2, -1)


def test_valid_value(spark):
    df = spark.createDataFrame([(1.0,), (-9999.0,), (float("nan"),), (float("inf"),), (None,)], "v float")
    assert [r[0] for r in df.select(bands.valid_value(F.col("v"))).collect()] == [1.0, None, None, None, None]


def test_stack_refuses_a_band_off_the_grid(spark):
    dem = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, value float")
    part = spark.createDataFrame([(0, 1, 5.0)], "row int, col int, value float")
    assert sorted(bands.stack_bands(dem, {"rate": part}).collect()) == [(0, 0, 1.0, None), (0, 1, 2.0, 5.0)]
    off = spark.createDataFrame([(7, 1, 5.0)], "row int, col int, value float")
    with pytest.raises(Exception, match="not on the DEM"):
        bands.stack_bands(dem, {"rate": off}).collect()


def scenario_file(tmp_path, extra=()):
    rows = [f"{s},{y},{a},{h + a}" for s, y, h in (("SSP2-4.5", 2050, 1.1), ("SSP2-4.5", 2100, 1.5), ("SSP5-8.5", 2050, 1.2), ("SSP5-8.5", 2100, 1.7)) for a in (0.0, 1.5, 3.0)]
    path = tmp_path / "s.csv"
    path.write_text("\n".join(["scenario,year,surge_m,water_level_used_egm2008_m", *rows, "SSP1-2.6,2050,0.0,9", "SSP2-4.5,2030,0.0,9", "SSP2-4.5,2050,2.0,9", "SSP2-4.5,2050,0.0,9", *extra]) + "\n")
    return str(path)


def test_scenarios(spark, tmp_path):
    got = bands.load_scenarios(spark, scenario_file(tmp_path)).collect()
    assert len(got) == 12 and got[0].water_level_egm2008_m == 1.1  # the first in the file counts
    with pytest.raises(ValueError, match="found 13"):
        bands.load_scenarios(spark, scenario_file(tmp_path, ["SSP2-4.5,2050,1.4999,9"]))


def test_select_population(spark):
    files = spark.createDataFrame([("a\\SSP2_2020.TIF",), ("a/SSP5_2050.tif",), ("a/ssp5_2050.tif",)], "path string")
    assert bands.select_population(files, "SSP2", 2020).count() == 1
    for s, y in (("SSP5", 2050), ("SSP1", 2020)):
        with pytest.raises(ValueError):
            bands.select_population(files, s, y)


def test_manifest(spark):
    sha = hashlib.sha256(b"abc").hexdigest()
    files = spark.createDataFrame([("a", "abc"), ("b", "abc"), ("c", "abc"), ("e", "abcd")], "file string, content string")
    listed = spark.createDataFrame([("a", 3, sha.upper()), ("b", 4, sha), ("d", 3, sha), ("e", 4, sha)], "file string, bytes int, sha256 string")
    got = {r.file: r.status for r in bands.verify_manifest(files, listed).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unlisted", "d": "missing", "e": "mismatch"}


def test_csv_has_a_byte_order_mark(spark, tmp_path):
    path = str(tmp_path / "t")
    bands.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), path, "csv")
    part = next((tmp_path / "t").glob("part-*"))
    assert part.read_bytes() == b"\xef\xbb\xbfa,b\n1,x\n"


def test_levels(spark):
    one = spark.range(1)
    years = [one.select(lv.decaying_effective_years(F.lit(y))).first()[0] for y in (2020, 2050, 2100, 2200)]
    assert years == pytest.approx([0, 20.833333333, 37.5, 37.5])
    got = one.select(lv.case_id(F.lit("SSP5-8.5"), F.lit(2050), F.lit(0.0))).first()[0]
    assert got == "SSP5m8p5_2050_added0p0m"
    value = one.select(*lv.parse_interval(F.lit("48.7 (45.2–52.3)"))).first()
    assert list(value) == [48.7, 45.2, 52.3]
    assert list(one.select(*lv.parse_interval(F.lit("none"))).first()) == [None] * 3
    clean = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "v float").select(lv.clean_subsidence(F.col("v")).alias("v"))
    assert [r.v for r in clean.collect()] == [0.0, 0.0, 2.0] and dict(clean.dtypes)["v"] == "float"
    events = spark.createDataFrame([(3.5, 1.2)], "total_level_m_cd double, tide_m_cd double")
    assert lv.event_levels(events).first()[2:] == pytest.approx((2.3, 2.966))


def test_unit_with_hole_and_shared_vertices(spark):
    grid = GridSpec(0, 1, 10, -1, 10, 10)
    ring = lambda pts: [(*a, *b) for a, b in zip(pts, pts[1:])]
    square = lambda a, b: ring([(a, a), (b, a), (b, b), (a, b), (a, a)])
    edges = spark.createDataFrame([(1, *e) for e in square(1.0, 9.0) + square(3.0, 6.0)], "unit_id int, x1 double, y1 double, x2 double, y2 double")
    spans = zones.cells_in_units(edges, grid).collect()
    cells = {(r.row, c) for r in spans for c in range(r.col_start, r.col_end + 1)}
    want = {(r, c) for r in range(1, 9) for c in range(1, 9)} - {(r, c) for r in range(4, 7) for c in range(3, 6)}
    assert cells == want


def test_overlap_denominators(spark):
    fine, coarse = GridSpec(0, 1, 0, -1, 3, 3), GridSpec(0, 2, 0, -2, 2, 2)
    mask = spark.createDataFrame([(0, 0), (2, 2)], "row int, col int")
    get = lambda kind: {(r.drow, r.dcol): r.fraction for r in resample.overlap_fraction(mask, fine, coarse, denominator=kind).collect()}
    assert get("contributing") == {(0, 0): 0.25, (1, 1): 1.0}
    assert get("full") == {(0, 0): 0.25, (1, 1): 0.25}
    people = spark.createDataFrame([(0, 0, 8.0), (1, 1, -5.0), (0, 1, None)], "prow int, pcol int, population double")
    assert resample.population_overlap(mask, fine, people, coarse).first()[0] == 2.0


def test_density_is_renormalised_at_the_rim(spark):
    fine, coarse = GridSpec(0, 1, 0, -1, 2, 2), GridSpec(0, 2, 0, -2, 1, 1)
    cells = spark.createDataFrame([(r, c) for r in range(2) for c in range(2)], "row int, col int")
    people = spark.createDataFrame([(0, 0, 100.0)], "prow int, pcol int, population double")
    got = {r.density for r in resample.density_on_grid(people, coarse, fine, cells).collect()}
    assert len(got) == 1 and got.pop() > 0


def test_domains_and_priority_edges(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, True, 1.0, None), (0, 1, None, True, 1.0, 1.0), (1, 0, 2.0, True, 1.0, 1.0)], "row int, col int, dem float, land boolean, rate float, sub_2100 float")
    grid = GridSpec(0, 0.001, 0, -0.001, 2, 2)
    got = {r.domain: r.pixels for r in areas.domain_summary(cells, grid).collect()}
    assert got == {"full_grid_valid": 2, "dem_valid_land": 2, "insar_support_all_cells": 2, "common_analysis_land": 1, "excluded_dem_land": 1}
    none = spark.createDataFrame([(0, 0, [0.0, 0.0])], "row int, col int, priority array<float>")
    assert pr.cutoffs(none, 2) == [0.0, 0.0]
    assert pr.hot_flags(none, [0.0, 0.0]).first().hot == [False, False]
    assert spark.range(1).select(pr.normalise_p(F.lit(1.0), 0.0)).first()[0] == 0.0


def test_sites(spark):
    series = spark.createDataFrame([(1, float(t), 2 + 3.0 * t - 0.5 * t * t) for t in range(6)] + [(2, 1.0, 1.0)], "site int, t double, y double")
    got = {r.site: r for r in st.site_trend(series).collect()}
    assert [got[1].c0, got[1].c1, got[1].c2] == pytest.approx([2, 3, -0.5]) and got[2].c0 is None
    maps = spark.createDataFrame([("six", '{"a": 8.3, "c": 27.97}'), ("six", '{"b": 20.0}')], "set string, distances string")
    assert st.site_distance_summary(maps).first()[1:] == pytest.approx((8.3, 27.97, 18.756667, 20.0))
    resid = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "site int, i long, e double")
    low, high = st.bootstrap_rmse(resid, 10, 3).first()[1:]
    assert low < high <= 4


def test_bootstrap_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(st, "SQUARES", 16)
    monkeypatch.setattr(st, "TOGETHER", 4)
    sizes, rows = {1: 1, 2: 16, 3: 17, 4: 100}, []
    for site, n in sizes.items():
        rows += [(site, i, float(rng.normal()) if i != 5 else None) for i in range(n)]
    got = {r.site: (r.rmse_low, r.rmse_high) for r in st.bootstrap_rmse(spark.createDataFrame(rows, "site int, i long, e double"), 10, 7).collect()}
    for site, n in sizes.items():
        ee = np.array([(e or 0.0) ** 2 for s, _, e in rows if s == site])
        rmse = []
        for rep in range(1, 11):
            at = [int(hashlib.md5(f"7|{site}|{rep}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]
            rmse.append(np.sqrt(ee[at].sum() / n))
        assert got[site] == pytest.approx((np.percentile(rmse, 2.5), np.percentile(rmse, 97.5)))
    assert st.bootstrap_rmse(spark.createDataFrame([], "site int, i long, e double")).collect() == []
