"""Registered queries, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import levels as lv
from ..grid import clip_extent, row_area_table
from ..operators import areas, flood, resample, runs, zones
from ..scratch import Scratch
from ..sources import bands, store
from . import fixtures as fx
from . import priority as pr
from . import scenarios as sc
from . import sites as st
from . import sql

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
BASE, DEEP = fx.TARGET.water_level_egm2008_m, 1.138469235


def query(name: str, text: str | None = None):
    def add(f):
        _queries[name] = f
        if text:
            _sql[name] = text
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded as a double, under its own name."""
    return F.round(F.col(c).cast("double"), digits).alias(c) if isinstance(c, str) else F.round(c.cast("double"), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(n, digits) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}::double, {digits}) as {n}" for n in names)


# --- sources and sinks


@query("s1_load_band", f"with {sql.BANDS} select row, col, round(nullif(dem, (-9999)::float)::double, 6) as value from bands")
def s1(spark, d):
    raw = Scratch(spark).save(fx.raw_bands(spark, d).select("row", "col", F.col("dem").alias("value")))
    return rounded(bands.load_band(spark, raw.scratch_path))


@query("s2_stack_bands", f"with {sql.CELLS} select row, col, {rs('dem', 'rate', 'sub_2050', 'sub_2100')} from cells")
def s2(spark, d):
    raw, names = fx.raw_bands(spark, d), ("dem", "rate", "sub_2050", "sub_2100")
    each, grid = {n: raw.select("row", "col", bands.valid_value(F.col(n)).alias("value")) for n in names}, fx.grid_of(spark, d)
    parts = flood.tile_parts(raw, grid, store.TILE)
    stack = Scratch(spark).save_by(store.stacked(each.pop("dem"), each, grid, store.TILE, parts), "tile", parts, dealt=True)
    return rounded(stack.drop("tile"))


def _scenario_rows(spark, d):
    o, k = fx.read(spark, d, "orders"), F.col("o_orderkey")
    pick = lambda values, by: F.array(*[F.lit(v) for v in values])[(by % len(values)).cast("int")]
    return o.select(
        pick(["SSP1-2.6", "SSP2-4.5", "SSP5-8.5"], k).alias("scenario"), pick([2030, 2050, 2100], F.col("o_custkey")).alias("year"),
        pick([0.0, 1.5, 3.0, 2.0], F.floor(k / 3)).alias("surge_m"), (F.lit(1.0) + k / 1024.0).alias("water_level_used_egm2008_m"), k,
    )


@query("s3_load_scenarios", """
with s as (select o_orderkey as k, ['SSP1-2.6', 'SSP2-4.5', 'SSP5-8.5'][(o_orderkey % 3) + 1] as scenario, [2030, 2050, 2100][(o_custkey % 3) + 1]::int as year,
    [0.0, 1.5, 3.0, 2.0][(o_orderkey // 3) % 4 + 1]::double as added_water_m, 1.0::double + o_orderkey / 1024.0::double as water_level_egm2008_m from orders),
f as (select *, row_number() over (partition by scenario, year, added_water_m order by k) as n from s
  where scenario in ('SSP2-4.5', 'SSP5-8.5') and year in (2050, 2100) and added_water_m in (0, 1.5, 3))
select scenario, year, added_water_m, water_level_egm2008_m from f where n = 1""")
def s3(spark, d):
    path = f"{Scratch(spark).root}/scenarios"
    rows = _scenario_rows(spark, d).orderBy("o_orderkey").drop("o_orderkey")
    rows.write.option("header", True).csv(path)  # sorted parts, named in order
    return bands.load_scenarios(spark, path)


@query("s4_select_population", "select 'grids/SSP2_2020.tif' as path, count(*) as cells from customer")
def s4(spark, d):
    name = F.concat(F.lit("grids/"), "pop_scenario", F.lit("_"), F.col("year").cast("string"), F.lit(".tif"))
    files = fx.population(spark, d).groupBy(name.alias("path")).agg(F.count("*").alias("cells"))
    return bands.select_population(files, "SSP2", 2020)


def _geojson(spark, d, name: str = "NAME_2", many: bool = False) -> str:
    """A GeoJSON file of the units, one of them without geometry. many: each ring is a polygon of a MultiPolygon."""
    grid = fx.grid_of(spark, d)
    ring = fx.unit_corners(spark, d, grid).withColumn("c", F.transform("corners", lambda p: F.array(p["x"], p["y"])))
    shape = ring.groupBy("unit_id", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "c"))), lambda p: p["c"]).alias("rings"))
    none = shape.where("unit_id = 0").select(F.lit(26).alias("unit_id"), F.lit("EMPTY").alias("name"), F.lit(None).cast("array<array<array<double>>>").alias("rings"))
    part = shape.unionByName(none).select("unit_id", F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("name").alias(name), F.lit("x").alias("GID_2")).alias("properties"),
        F.when(F.col("rings").isNotNull(), F.struct(F.lit("MultiPolygon" if many else "Polygon").alias("type"), (F.transform("rings", lambda ring: F.array(ring)) if many else F.col("rings")).alias("coordinates"))).alias("geometry"),
    ).alias("f"))
    whole = part.agg(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", F.to_json("f").alias("f")))), lambda x: x["f"]).alias("fs"))
    path = f"{Scratch(spark).root}/units"
    whole.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("fs", ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return path


@query("s5_load_admin_units", """
select n_name as name, case when n_nationkey % 2 = 0 then 8 else 4 end::bigint as edges, case when n_nationkey % 2 = 0 then 2 else 1 end::bigint as rings from nation where n_nationkey < 25
union all select 'SEA', 4, 1""")
def s5(spark, d):
    grid = fx.grid_of(spark, d)
    units, edges = bands.load_admin_units(spark, _geojson(spark, d), grid.extent())
    return edges.join(units, "unit_id").groupBy("name").agg(F.count("*").alias("edges"), F.count_distinct("part", "ring").alias("rings"))


@query("s5_load_multipolygons", """
select n_name as name, case when n_nationkey % 2 = 0 then 8 else 4 end::bigint as edges, case when n_nationkey % 2 = 0 then 2 else 1 end::bigint as parts from nation where n_nationkey < 25
union all select 'SEA', 4, 1""")
def s5_many(spark, d):
    grid = fx.grid_of(spark, d)
    units, edges = bands.load_admin_units(spark, _geojson(spark, d, "NAME_1", True), grid.extent())
    return edges.join(units, "unit_id").groupBy("name").agg(F.count("*").alias("edges"), F.count_distinct("part").alias("parts"))


PAIR = [(0.0, "none", BASE, 8), (0.0, "c2100", BASE, 8)]


def _pair(spark, d):
    cells, grid = fx.cells(spark, d), fx.grid_of(spark, d)
    surfaces = {"dem": F.col("dem"), "sub": lv.adjusted_surface(F.col("dem"), F.col("sub_2100_clean"))}
    return flood.connected_flood(cells, grid, surfaces, [flood.Case("dem", BASE), flood.Case("sub", BASE)], carry=("common",))


PAIRED = f"""with recursive {sql.CELLS}, {sql.floods(PAIR)},
pm as (select row, col, bool_or(k = 0) as baseline, bool_or(k = 1) as adjusted from fl where common group by 1, 2)"""


@query("s6_write_masks", PAIRED + """ select 'SSP5m8p5_2100_added0p0m' as case_id, label, count(*) as cells from (
  select 'baseline' as label from pm where baseline union all select 'continued' from pm where adjusted union all select 'added' from pm where adjusted and not baseline) group by 1, 2""")
def s6(spark, d):
    pm = flood.paired_masks(_pair(spark, d), 0, 1)
    label = F.explode(F.array_compact(F.array(F.when(F.col("baseline"), F.lit("baseline")), F.when(F.col("adjusted"), F.lit("continued")), F.when(F.col("added"), F.lit("added")))))
    masks = pm.select(F.lit("SSP5m8p5_2100_added0p0m").alias("case_id"), label.alias("label"), "row", "col")
    path = f"{Scratch(spark).root}/masks"
    bands.write_masks(masks, path)
    return spark.read.parquet(path).groupBy("case_id", "label").agg(F.count("*").alias("cells"))


def _pairs_of_all():
    """The plan of the twelve cases under the continued trend, and their SQL."""
    plan, cases = sc.FloodPlan(), []
    for s in fx.SCENARIOS:
        b = plan.case("dem", lv.adjusted_surface(F.col("dem"), F.lit(0.0).cast("float")), s.water_level_egm2008_m)
        a = plan.case(f"sub_{s.year}", lv.adjusted_surface(F.col("dem"), F.col(f"sub_{s.year}_clean")), s.water_level_egm2008_m)
        plan.pair(b, a, scenario=s.scenario, year=s.year, added=s.added_water_m, level=s.water_level_egm2008_m)
    return plan


def _all_masks_sql() -> str:
    cases, rows = [], []
    for s in fx.SCENARIOS:
        own = [(0.0, "none", s.water_level_egm2008_m, 8), (0.0, f"c{s.year}", s.water_level_egm2008_m, 8)]
        cases += [c for c in own if c not in cases]
        name = f"{s.scenario.replace('-', 'm').replace('.', 'p')}_{s.year}_added{s.added_water_m:.1f}m".replace(".", "p")
        rows.append((name, f"{s.water_level_egm2008_m:.9f}", *[cases.index(c) for c in own]))
    values = ", ".join(f"('{n}', '{w}', {b}, {a})" for n, w, b, a in rows)
    return f"""with recursive {sql.CELLS}, {sql.floods(cases)}, prs(case_id, level, b, a) as (values {values}), fc_ as (select k, row, col from fl where common),
m as (select case_id, level, 'baseline' as label, row, col from prs join fc_ on k = b union all select case_id, level, 'continued', row, col from prs join fc_ on k = a
  union all select case_id, level, 'added', row, col from prs join fc_ x on x.k = a where not exists (select 1 from fc_ y where y.k = b and y.row = x.row and y.col = x.col))
select case_id, label, count(*) as cells, level as water_level_egm2008_m, 'continued_trend' as persistence, '8-neighbour' as connectivity from m group by 1, 2, 4"""


@query("s6_write_masks_all", _all_masks_sql())
def s6_all(spark, d):
    plan = _pairs_of_all()
    n = len(plan.cases)
    made = plan.runs(fx.cells(spark, d), fx.grid_of(spark, d))
    named = plan.names(spark, "scenario string, year int, added double, level double").select("pair", lv.case_id(F.col("scenario"), F.col("year"), F.col("added")).alias("case_id"), "level")
    sides = [(i, m, label) for i, (b, a, _) in enumerate(plan.pairs) for label, m in (("baseline", b), ("continued", a), ("added", n + i))]
    keyed = spark.createDataFrame(sides, "pair int, mask int, label string").join(named, "pair")
    tags = named.select("case_id", F.lit("common analysis land").alias("domain"), F.lit("8-neighbour").alias("connectivity"), F.format_string("%.9f", "level").alias("water_level_egm2008_m"), F.lit("continued_trend").alias("persistence"))
    path = f"{Scratch(spark).root}/masks"
    bands.write_run_masks(made.join(F.broadcast(keyed), "mask").select("case_id", "label", "row", "start", "stop"), tags, path)
    back, tags = bands.read_run_masks(spark, path)
    cells = back.groupBy("case_id", "label").agg(F.sum(F.col("stop") - F.col("start")).alias("cells"))
    return cells.join(tags, "case_id").select("case_id", "label", "cells", "water_level_egm2008_m", "persistence", "connectivity")


@query("s7_write_layer", f"with {sql.CELLS} select row, col, round(case when common then rate_clean else (-9999)::float end::double, 6) as value from cells")
def s7(spark, d):
    path = f"{Scratch(spark).root}/layer"
    bands.write_layer(fx.cells(spark, d), F.col("rate_clean"), F.col("common"), path)
    return rounded(spark.read.parquet(path))


SUMMARY = f"""with {sql.CELLS}, {sql.AREA},
m as (select c.row, area_km2, dem is not null as v, dem is not null and land as l, rate is not null and sub_2100 is not null as s from cells c join ra using (row)),
one as (select unnest(['full_grid_valid', 'dem_valid_land', 'insar_support_all_cells', 'common_analysis_land', 'excluded_dem_land']) as domain,
   unnest([count(*) filter (v), count(*) filter (l), count(*) filter (s), count(*) filter (l and s), count(*) filter (l and not s)]) as pixels,
   unnest([sum(area_km2) filter (v), sum(area_km2) filter (l), sum(area_km2) filter (s), sum(area_km2) filter (l and s), sum(area_km2) filter (l and not s)]) as area_km2 from m)"""
SHARE = "area_km2 * 100 / (select area_km2 from one where domain = 'dem_valid_land')"


@query("s8_write_table", SUMMARY + " select domain, pixels, round(area_km2, 6) as area_km2 from one")
def s8(spark, d):
    path = f"{Scratch(spark).root}/summary"
    bands.write_table(rounded(areas.domain_summary(fx.cells(spark, d), fx.grid_of(spark, d))).select("domain", "pixels", "area_km2"), path, "csv")
    back = spark.read.option("header", True).schema("domain string, pixels long, area_km2 double").csv(path)
    return back.select(*[F.col(c).alias(c.lstrip("﻿")) for c in back.columns])


BUILT = f"{sql.TO_CELLS},\n" + ",\n".join(
    f"t{t} as ({sql.class_tile(t)}), f{t} as ({sql.fraction(f'(select * from t{t} where class = 50)', 'k')})" for t in (0, 1)
) + ",\nbuilt as (select drow as row, dcol as col, max(fraction) as fraction from (select * from f0 union all select * from f1) group by 1, 2)"


def _built(spark, d):
    grid, kg = fx.grid_of(spark, d), fx.class_grid_of(spark, d)
    return resample.merge_max(*[resample.class_fraction(fx.classes(spark, d, t), 50, kg, grid) for t in (0, 1)])


def _shares(spark, d):
    cells, grid, pg = fx.cells(spark, d), fx.grid_of(spark, d), fx.pop_grid_of(spark, d)
    marked = areas.domain_masks(cells)
    whole = areas.mask_area(marked.where("dem_valid_land"), grid, (), common=F.col("common_analysis_land")).select(F.col("area_km2").alias("total"), F.col("common_area_km2").alias("common"))
    frac = marked.join(_built(spark, d), ["row", "col"])
    built = areas.weighted_area(frac, "fraction", grid, total=F.col("dem_valid_land"), common=F.col("common_analysis_land"))
    pop = fx.population(spark, d).where("pop_scenario = 'SSP2' and year = 2020").drop("pop_scenario", "year")
    sides = marked.select("row", "col", F.explode(F.array_compact(F.array(F.when(F.col("dem_valid_land"), F.lit("total")), F.when(F.col("common_analysis_land"), F.lit("common"))))).alias("side"))
    people = resample.population_overlap(sides, grid, pop, pg, by=("side",)).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("population"))), F.lit(0.0)).alias(s) for s in ("total", "common")])
    return areas.representativeness(whole, built, people)


SHARES = f"""with {sql.CELLS}, {sql.AREA}, {BUILT}, {sql.POPULATION}, {sql.TO_POP},
lt as (select row, col from cells where land), lc as (select row, col from cells where land and rate is not null and sub_2100 is not null),
pt as ({sql.fraction('lt', 'p')}), pc as ({sql.fraction('lc', 'p')}),
p20 as (select * from pop where pop_scenario = 'SSP2' and year = 2020 and population >= 0),
a as (select (select sum(area_km2) from lt join ra using (row)) as land_total, (select sum(area_km2) from lc join ra using (row)) as land_common,
  (select sum(fraction * area_km2) from lt join built using (row, col) join ra using (row)) as built_total,
  (select sum(fraction * area_km2) from lc join built using (row, col) join ra using (row)) as built_common,
  (select sum(population * fraction) from pt join p20 on prow = drow and pcol = dcol) as population_total,
  (select sum(population * fraction) from pc join p20 on prow = drow and pcol = dcol) as population_common),
sh as (select *, land_common * 100 / land_total as land_share_percent, built_common * 100 / built_total as built_share_percent,
  population_common * 100 / population_total as population_share_percent from a)"""
SHARE_NAMES = [f"{a}_{b}" for a in ("land", "built", "population") for b in ("total", "common", "share_percent")]


@query("s9_audit_report", SHARES + f""" select 4::bigint as bands, 5::bigint as domains, (select round(max(dem)::double, 4) from cells) as dem_maximum, round(population_share_percent, 4) as population_share_percent from sh""")
def s9(spark, d):
    cells, grid = fx.cells(spark, d), fx.grid_of(spark, d)
    report = bands.audit_report(areas.domain_summary(cells, grid), areas.band_stats(cells, ["dem", "rate", "sub_2050", "sub_2100"]), _shares(spark, d))
    path = f"{Scratch(spark).root}/report"
    report.coalesce(1).write.json(path)
    back = spark.read.schema(report.schema).json(path)
    top = F.filter("bands", lambda b: b["band"] == "dem")[0]["maximum"]
    return back.select(F.size("bands").cast("long").alias("bands"), F.size("domains").cast("long").alias("domains"), F.round(top, 4).alias("dem_maximum"), F.round("representativeness.population_share_percent", 4).alias("population_share_percent"))


@query("s9_audit_grid", f"""with {sql.CELLS} select unnest(['dem', 'rate', 'sub_2050', 'sub_2100']) as band, 'EPSG:4326' as crs, 100::int as width, nrows::int as height, 112.0::double as west, round(22.8 - 0.0005 * nrows, 9)::double as south,
  112.05::double as east, 22.8::double as north, 0.0005::double as pixel_width, 0.0005::double as pixel_height, (-9999)::double as nodata from size""")
def s9_grid(spark, d):
    cells, grid = fx.cells(spark, d), fx.grid_of(spark, d)
    report = bands.audit_report(areas.domain_summary(cells, grid), areas.band_stats(cells, ["dem", "rate", "sub_2050", "sub_2100"]), _shares(spark, d), grid)
    path = f"{Scratch(spark).root}/report"
    report.coalesce(1).write.json(path)
    back = spark.read.schema(report.schema).json(path).select(F.inline("bands"))
    return rounded(back.select("band", "grid.*"), 9)


@query("s10_verify_manifest", """
select doc_id as file, case when doc_id % 50 = 1 then 'unlisted' when doc_id % 50 = 2 then 'mismatch' else 'ok' end as status from documents
union all select 1000000000 + r, 'missing' from range(5) t(r)""")
def s10(spark, d):
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    sha = F.sha2(F.col("content").cast("binary"), 256)
    listed = docs.where("file % 50 <> 1").select("file", F.octet_length("content").alias("bytes"), F.when(F.col("file") % 50 == 2, F.reverse(sha)).otherwise(F.upper(sha)).alias("sha256"))
    gone = spark.range(5).select((F.col("id") + 1000000000).alias("file"), F.lit(1).alias("bytes"), F.lit("0").alias("sha256"))
    return bands.verify_manifest(docs, listed.union(gone))


# --- projections


@query("p1_row_area", f"with {sql.CELLS}, {sql.AREA} select row, round(area_km2, 10) as area_km2 from ra")
def p1(spark, d):
    return rounded(row_area_table(spark, fx.grid_of(spark, d)), 10)


@query("p2_domain_masks", f"""with {sql.CELLS} select row, col, dem is not null as full_grid_valid, land as dem_valid_land, rate is not null and sub_2100 is not null as insar_support_all_cells,
  land and rate is not null and sub_2100 is not null as common_analysis_land, land and not (rate is not null and sub_2100 is not null) as excluded_dem_land from cells""")
def p2(spark, d):
    return areas.domain_masks(fx.cells(spark, d)).select("row", "col", *areas.DOMAINS)


@query("p3_clean_subsidence", f"with {sql.CELLS} select row, col, {rs('rate_clean', 'sub_2050_clean', 'sub_2100_clean')} from cells")
def p3(spark, d):
    return rounded(fx.cells(spark, d).select("row", "col", "rate_clean", "sub_2050_clean", "sub_2100_clean"))


@query("p4_effective_years", """
select event_id, (2020 + event_id % 90)::int as year, round(t - t * t / 150, 6) as years from (select event_id, least(greatest(2020 + event_id % 90 - 2025, 0), 75)::double as t from events)""")
def p4(spark, d):
    year = (2020 + F.col("event_id") % 90).cast("int")
    return fx.read(spark, d, "events").select("event_id", year.alias("year"), F.round(lv.decaying_effective_years(year), 6).alias("years"))


@query("p5_persistence", f"""with {sql.CELLS}
select row, col, unnest(['stabilisation', 'decaying_trend', 'continued_trend']) as persistence,
  unnest([0::double, round(least(rate_clean * {lv.decayed_years(2050)!r}::float, 1.5::float)::double, 5), round(sub_2050_clean::double, 5)]) as sub from cells""")
def p5(spark, d):
    cells = fx.cells(spark, d).select("row", "col", F.col("rate_clean").alias("rate"), F.col("sub_2050_clean").alias("sub_2050"))
    return rounded(lv.persistence_subsidence(cells, 2050), 5)


@query("p6_adjusted_surface", f"with {sql.CELLS} select row, col, round(((dem + 0.5::float) - sub_2100_clean)::double, 5) as surface from cells")
def p6(spark, d):
    return rounded(fx.cells(spark, d).select("row", "col", lv.adjusted_surface(F.col("dem"), F.col("sub_2100_clean"), 0.5).alias("surface")), 5)


@query("p7_water_levels", """
select 'S' || n_regionkey as scenario, (2050 + 50 * (n_nationkey % 2))::int as year, l_linenumber * 0.5::double as added_water_m,
  round(0.9::double + r_regionkey * 0.01::double + n_nationkey * 0.02::double + l_linenumber * 0.5::double, 6) as water_level_egm2008_m
from region, nation, (select distinct l_linenumber from lineitem)""")
def p7(spark, d):
    base = fx.read(spark, d, "region").select((F.lit(0.9) + F.col("r_regionkey") * 0.01).alias("h0_m"))
    rise = fx.read(spark, d, "nation").select(F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("scenario"), (2050 + 50 * (F.col("n_nationkey") % 2)).cast("int").alias("year"), (F.col("n_nationkey") * 0.02).alias("rise_m"))
    added = fx.read(spark, d, "lineitem").select((F.col("l_linenumber") * 0.5).alias("added_water_m")).distinct()
    return rounded(lv.water_levels(base, rise, added))


@query("p8_event_levels", "select event_id, round(value / 50 - value / 80, 6) as residual_m, round(value / 50 + -0.534::double, 6) as peak_m_egm2008 from events")
def p8(spark, d):
    e = fx.read(spark, d, "events").select("event_id", (F.col("value") / 50).alias("total_level_m_cd"), (F.col("value") / 80).alias("tide_m_cd"))
    return rounded(lv.event_levels(e).select("event_id", "residual_m", "peak_m_egm2008"))


@query("p9_case_id", """
select event_id, 'SSP' || (event_id % 5 + 1) || 'm' || (event_id % 9) || 'p' || (event_id % 10) || '_' || (2050 + event_id % 3) || '_added' || (event_id % 7 // 2) || 'p' || (event_id % 7 % 2 * 5) || 'm' as case_id from events""")
def p9(spark, d):
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("SSP"), s(k % 5 + 1), F.lit("-"), s(k % 9), F.lit("."), s(k % 10))
    return fx.read(spark, d, "events").select("event_id", lv.case_id(name, 2050 + k % 3, k % 7 * 0.5).alias("case_id"))


@query("p10_pick_cases", """
select event_id, scenario, year, round(added_water_m, 6) as added_water_m from (select event_id, event_type as scenario, (2050 + 50 * (event_id % 2))::int as year,
  event_id % 4 * 1.5::double + event_id % 3 * 0.00001::double as added_water_m from events) where scenario = 'view' and year = 2100 and abs(added_water_m - 1.5) <= 1e-8 + 1e-5 * 1.5""")
def p10(spark, d):
    k = F.col("event_id")
    t = fx.read(spark, d, "events").select("event_id", F.col("event_type").alias("scenario"), (2050 + 50 * (k % 2)).cast("int").alias("year"), (k % 4 * 1.5 + k % 3 * 0.00001).alias("added_water_m"))
    return rounded(lv.pick_cases(t, "view", 2100, 1.5))


CLIP = (112.00512, 112.0301, 22.7953, 22.7989)


@query("p11_clip_extent", f"with {sql.CELLS} select row, col, {rs('dem')} from cells, size where col between 10 and 60 and row between 2 and least(9, nrows - 1)")
def p11(spark, d):
    return rounded(clip_extent(fx.cells(spark, d), fx.grid_of(spark, d), *CLIP).select("row", "col", "dem"))


@query("p12_overview", f"with {sql.CELLS} select row // 3 as row, col // 3 as col, case when common then 2 when land then 1 else 0 end as class from cells where row % 3 = 0 and col % 3 = 0")
def p12(spark, d):
    return areas_overview(fx.cells(spark, d), 3)


def areas_overview(cells: DataFrame, step: int, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """(row, col, class): every step-th cell, numbered anew; 2 common land, 1 other land, 0 neither."""
    a, b = F.col("row") - offset[0], F.col("col") - offset[1]
    kind = F.when(F.col("common"), 2).when(F.col("land"), 1).otherwise(0)
    return cells.where((a >= 0) & (b >= 0) & (a % step == 0) & (b % step == 0)).select(F.floor(a / step).cast("int").alias("row"), F.floor(b / step).cast("int").alias("col"), kind.alias("class"))


def _main_cases():
    """Cases of the main table in its own order, and its pairs, for the SQL."""
    cases, pairs = [], []
    for s in fx.SCENARIOS:
        b = (0.0, "none", s.water_level_egm2008_m, 8)
        for p in lv.PERSISTENCE:
            a = b if p == "stabilisation" else (0.0, f"{p[0]}{s.year}", s.water_level_egm2008_m, 8)
            for c in (b, a):
                if c not in cases:
                    cases.append(c)
            pairs.append((s.scenario, s.year, s.added_water_m, s.water_level_egm2008_m, p, cases.index(b), cases.index(a)))
    return cases, pairs


def _pairs_sql(pairs, names: str) -> str:
    v = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else repr(x) for x in p) + ")" for p in pairs)
    return f"pairs({names}, b, a) as (values {v})"


PAIR_AREAS = f"""{sql.AREA}, fc_common as (select k, row, col from fl where common),
ka as (select k, sum(area_km2) as km2 from fc_common join ra using (row) group by 1),
kd as (select p.b, p.a, sum(area_km2) as km2 from (select distinct b, a from pairs) p join fc_common x on x.k = p.a join ra using (row)
  where not exists (select 1 from fc_common y where y.k = p.b and y.row = x.row and y.col = x.col) group by 1, 2),
pa as (select p.*, coalesce(xb.km2, 0) as b_km2, coalesce(xa.km2, 0) as a_km2, coalesce(kd.km2, 0) as d_km2 from pairs p
  left join ka xb on xb.k = p.b left join ka xa on xa.k = p.a left join kd on kd.b = p.b and kd.a = p.a)"""


def _main_sql() -> str:
    cases, pairs = _main_cases()
    people = sql.fraction("fc_common", "p", "k")
    return f"""with recursive {sql.CELLS}, {sql.floods(cases)}, {_pairs_sql(pairs, 'scenario, year, added_water_m, water_level_egm2008_m, persistence')},
{PAIR_AREAS}, {sql.POPULATION}, {sql.TO_POP}, fr as ({people}),
ke as (select fr.k, pop_scenario, year, sum(population * fraction) as people from fr join pop on prow = drow and pcol = dcol where population >= 0 group by 1, 2, 3),
main as (select pa.*, (select sum(area_km2) from cells join ra using (row) where common) as common_km2, coalesce(eb.people, 0) as b_people, coalesce(ea.people, 0) as a_people from pa
  left join ke eb on eb.k = pa.b and eb.year = pa.year and eb.pop_scenario = case when scenario like 'SSP2%' then 'SSP2' else 'SSP5' end
  left join ke ea on ea.k = pa.a and ea.year = pa.year and ea.pop_scenario = case when scenario like 'SSP2%' then 'SSP2' else 'SSP5' end)"""


MAIN = _main_sql()


def _main(spark, d):
    return sc.main_scenarios(fx.cells(spark, d), fx.grid_of(spark, d), fx.SCENARIOS, fx.population(spark, d), fx.pop_grid_of(spark, d))


@query("p13_scenario_source", MAIN + """ select scenario, year::int as year, added_water_m, water_level_egm2008_m, round(b_km2, 6) as baseline_connected_area_km2,
  round(a_km2, 6) as continued_trend_connected_area_km2, round(a_km2 - b_km2, 6) as difference_km2 from main where year = 2050 and persistence = 'continued_trend'""")
def p13(spark, d):
    out = sc.scenario_source(_main(spark, d), 2050)
    return out.select("scenario", "year", "added_water_m", "water_level_egm2008_m", *[r(c) for c in out.columns[4:]])


@query("p14_report_rounding", """
select c_nationkey as nation, round_even(sum(c_acctbal) / 10, 0) as land_area_km2, round_even(sum(c_acctbal) * 97 / 1000000, 2) as exposed_population_million, round_even(avg(c_acctbal) / 1000, 2) as water_level_m
from customer group by 1""")
def p14(spark, d):
    c = fx.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    return lv.report_rounding(c.agg((F.sum("c_acctbal") / 10).alias("land_area_km2"), (F.sum("c_acctbal") * 97).alias("exposed_population"), (F.avg("c_acctbal") / 1000).alias("water_level_m")))


@query("p15_parse_interval", """
select c_custkey, case when c_custkey % 11 <> 0 then c_custkey % 90 + c_custkey % 10 / 10::double end as value, case when c_custkey % 11 <> 0 then (c_custkey % 90)::double end as low,
  case when c_custkey % 11 <> 0 then c_custkey % 90 + 2.5::double end as high from customer""")
def p15(spark, d):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    text = F.concat(s(k % 90), F.lit("."), s(k % 10), F.lit(" ("), s(k % 90), F.lit(".0–"), s(k % 90 + 2), F.lit(".5)"))
    text = F.when(k % 11 == 0, F.lit("n/a")).otherwise(text)
    return fx.read(spark, d, "customer").select("c_custkey", *[c.alias(n) for c, n in zip(lv.parse_interval(text), ("value", "low", "high"))])


# --- connectivity


#: Cells on a side of the tiles of the queries that put small grids into many tiles.
SMALL_TILE = 16


def _floods(spark, d, neighbours, **how):
    cells, grid = fx.cells(spark, d), fx.grid_of(spark, d)
    surfaces = {"dem": F.col("dem"), "sub": lv.adjusted_surface(F.col("dem"), F.col("sub_2100_clean"))}
    cases = [flood.Case("dem", DEEP, neighbours), flood.Case("dem", BASE, neighbours), flood.Case("sub", DEEP, neighbours), flood.Case("sub", BASE, neighbours)]
    return flood.hit_cells(flood.connected_flood(cells, grid, surfaces, cases, **how), ["low", "high", "low_sunk", "high_sunk"])


def _flood_sql(n):
    cases = [(0.0, "none", DEEP, n), (0.0, "none", BASE, n), (0.0, "c2100", DEEP, n), (0.0, "c2100", BASE, n)]
    return f"with recursive {sql.CELLS}, {sql.floods(cases)} select ['low', 'high', 'low_sunk', 'high_sunk'][k + 1] as case_id, row, col from fl"


@query("c1_connected_flood", _flood_sql(8))
def c1(spark, d):
    return _floods(spark, d, 8)


@query("c2_connected_flood_4", _flood_sql(4))
def c2(spark, d):
    return _floods(spark, d, 4)


@query("c1_connected_flood_tiles", _flood_sql(8))
def c1_tiles(spark, d):
    return _floods(spark, d, 8, tile=SMALL_TILE)


@query("c2_connected_flood_4_tiles", _flood_sql(4))
def c2_tiles(spark, d):
    return _floods(spark, d, 4, tile=SMALL_TILE)


@query("c3_paired_masks", PAIRED + " select row, col, baseline, adjusted, adjusted and not baseline as added from pm")
def c3(spark, d):
    return flood.paired_masks(_pair(spark, d), 0, 1)


@query("c4_edge_cells", f"""with {sql.CELLS}, m as (select row, col from cells where common)
select a.row, a.col from m a left join m b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2 having count(*) < 9""")
def c4(spark, d):
    return flood.edge_cells(fx.cells(spark, d).where("common"))


# --- resampling and zones


@query("j1_overlap_fraction", f"with {sql.CELLS}, {sql.TO_POP}, m as (select row, col from cells where common), f as ({sql.fraction('m', 'p')}) select drow, dcol, round(fraction, 6) as fraction from f")
def j1(spark, d):
    return rounded(resample.overlap_fraction(fx.cells(spark, d).where("common"), fx.grid_of(spark, d), fx.pop_grid_of(spark, d)))


@query("j1_overlap_fraction_runs", f"with {sql.CELLS}, {sql.TO_POP}, m as (select row, col from cells where common), f as ({sql.fraction('m', 'p')}) select drow, dcol, round(fraction, 6) as fraction from f")
def j1_runs(spark, d):
    return rounded(runs.run_overlap(runs.cells_to_runs(fx.cells(spark, d).where("common")), fx.grid_of(spark, d), fx.pop_grid_of(spark, d), ()))


@query("j2_population_overlap", f"""with {sql.CELLS}, {sql.TO_POP}, {sql.POPULATION}, m as (select row, col from cells where common), f as ({sql.fraction('m', 'p')})
select pop_scenario, year, round(sum(population * fraction), 4) as population from f join pop on prow = drow and pcol = dcol where population >= 0 group by 1, 2""")
def j2(spark, d):
    mask = fx.cells(spark, d).where("common").select("row", "col")
    return rounded(resample.population_overlap(mask, fx.grid_of(spark, d), fx.population(spark, d), fx.pop_grid_of(spark, d), ("pop_scenario", "year")), 4)


@query("j3_class_fraction", f"with {sql.CELLS}, {sql.TO_CELLS}, m as (select * from ({sql.class_tile()}) where class = 50), f as ({sql.fraction('m', 'k')}) select drow as row, dcol as col, round(fraction, 6) as fraction from f")
def j3(spark, d):
    return rounded(resample.class_fraction(fx.classes(spark, d), 50, fx.class_grid_of(spark, d), fx.grid_of(spark, d)))


@query("j3_class_fraction_runs", f"with {sql.CELLS}, {sql.TO_CELLS}, m as (select * from ({sql.class_tile()}) where class = 50), f as ({sql.fraction('m', 'k')}) select drow as row, dcol as col, round(fraction, 6) as fraction from f")
def j3_runs(spark, d):
    built = runs.run_overlap(runs.cells_to_runs(fx.classes(spark, d).where("class = 50")), fx.class_grid_of(spark, d), fx.grid_of(spark, d), ())
    return rounded(built.select(F.col("drow").alias("row"), F.col("dcol").alias("col"), "fraction"))


@query("j4_merge_max", f"with {sql.CELLS}, {BUILT} select row, col, round(fraction, 6) as fraction from built")
def j4(spark, d):
    return rounded(_built(spark, d))


def _dense(spark, d):
    pop = fx.population(spark, d).where("pop_scenario = 'SSP2' and year = 2020")
    return resample.density_on_grid(pop, fx.pop_grid_of(spark, d), fx.grid_of(spark, d), fx.cells(spark, d))


@query("j5_density", f"with {sql.CELLS}, {sql.POPULATION}, {sql.DENSITY} select row, col, round(density::double, 2) as density from dens")
def j5(spark, d):
    return rounded(_dense(spark, d).select("row", "col", "density"), 2)


UNITS = """bl as (select 0.0005::double * 100 / 5 as bw, -0.0005::double * nrows / 5 as bh, nrows from size),
ring as (select n_nationkey as unit_id, n_name as name, 112.0::double + bw * (n_nationkey % 5 + 0.5::double) as cx, 22.8::double + bh * (n_nationkey // 5 + 0.5::double) as cy, bw / 2 * s as ax, bh / 2 * s as ay
  from nation, bl, (values (0, 0.93::double), (1, 0.31::double)) v(h, s) where n_nationkey < 25 and (h = 0 or n_nationkey % 2 = 0)),
inside as (select unit_id, any_value(name) as name, row, col from ring, cells
  where abs(112.0::double + 0.0005::double * (col + 0.5::double) - cx) / abs(ax) + abs(22.8::double - 0.0005::double * (row + 0.5::double) - cy) / abs(ay) < 1
  group by unit_id, row, col having count(*) % 2 = 1)"""


@query("j6_cells_in_units", f"with {sql.CELLS}, {UNITS} select unit_id, row, col from inside union all select 25, row, col from cells, size where row between 1 and nrows - 2 and col between 1 and 5")
def j6(spark, d):
    grid = fx.grid_of(spark, d)
    spans = zones.cells_in_units(fx.unit_edges(spark, d, grid), grid)
    return spans.select("unit_id", "row", F.explode(F.sequence("col_start", "col_end")).alias("col"))


SITES = """si as (select s_suppkey as site, 112.0::double + 0.0005::double * (s_suppkey % 100) + 0.0001::double as lon, 22.8::double - 0.0005::double * ((s_suppkey // 100) % 10) - 0.0002::double as lat from supplier),
sp as (select site, lon, lat, floor((lat - 22.8::double) / (-0.0005)::double)::int as row, floor((lon - 112.0::double) / 0.0005::double)::int as col from si),
sd as (select *, 2 * 6371008.8::double * asin(sqrt(pow(sin((radians(22.8::double - 0.0005::double * (row + 0.5::double)) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(22.8::double - 0.0005::double * (row + 0.5::double))) * pow(sin(radians(112.0::double + 0.0005::double * (col + 0.5::double) - lon) / 2), 2))) as distance_m from sp)"""


@query("j7_nearest_pixel", f"with {sql.CELLS}, {SITES} select site, sd.row, sd.col, round(distance_m, 3) as distance_m, round(dem::double, 5) as value from sd left join cells using (row, col)")
def j7(spark, d):
    out = zones.nearest_pixel(fx.sites(spark, d), fx.cells(spark, d), fx.grid_of(spark, d))
    return out.select("site", "row", "col", r("distance_m", 3), r("value", 5))


@query("j7_nearest_value", f"""with {sql.CELLS}, {SITES}, nv as (select site, c.row, c.col, dem, 2 * 6371008.8::double * asin(sqrt(pow(sin((radians(22.8::double - 0.0005::double * (c.row + 0.5::double)) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(22.8::double - 0.0005::double * (c.row + 0.5::double))) * pow(sin(radians(112.0::double + 0.0005::double * (c.col + 0.5::double) - lon) / 2), 2))) as d from si, cells c where dem is not null),
nr as (select *, row_number() over (partition by site order by round(d, 6), row, col) as n from nv)
select site, row, col, round(d, 3) as distance_m, round(dem::double, 5) as value from nr where n = 1""")
def j7_value(spark, d):
    return zones.nearest_value(fx.sites(spark, d), fx.cells(spark, d), fx.grid_of(spark, d)).select("site", "row", "col", r("distance_m", 3), r("value", 5))


@query("j8_masked_density", f"with recursive {sql.CELLS}, {sql.POPULATION}, {sql.DENSITY}, {sql.floods([PAIR[1]])} select row, col, round(density::double, 2) as density from dens join fl using (row, col)")
def j8(spark, d):
    return rounded(resample.masked_density(_dense(spark, d).select("row", "col", "density"), _pair(spark, d).where(F.array_contains("hits", 1))), 2)


# --- areas and tables


@query("a1_mask_area", f"with {sql.CELLS}, {sql.AREA} select land, common, count(*) as pixels, round(sum(area_km2), 6) as area_km2 from cells join ra using (row) group by 1, 2")
def a1(spark, d):
    return rounded(areas.mask_area(fx.cells(spark, d), fx.grid_of(spark, d), ("land", "common")))


@query("a1_mask_area_runs", f"with {sql.CELLS}, {sql.AREA} select land, common, count(*) as pixels, round(sum(area_km2), 6) as area_km2 from cells join ra using (row) group by 1, 2")
def a1_runs(spark, d):
    by = ("land", "common")
    return rounded(runs.run_area(runs.cells_to_runs(fx.cells(spark, d), by), fx.grid_of(spark, d), by))


@query("a2_domain_summary", SUMMARY + f" select domain, pixels, round(area_km2, 6) as area_km2, round({SHARE}, 4) as share_of_dem_land_percent from one")
def a2(spark, d):
    out = areas.domain_summary(fx.cells(spark, d), fx.grid_of(spark, d))
    return out.select("domain", "pixels", r("area_km2"), r("share_of_dem_land_percent", 4))


@query("a3_band_stats", f"""with {sql.CELLS} select unnest(['dem', 'rate', 'sub_2050', 'sub_2100']) as band, unnest([count(dem), count(rate), count(sub_2050), count(sub_2100)]) as valid_pixels,
  unnest([round(min(dem)::double, 5), round(min(rate)::double, 5), round(min(sub_2050)::double, 5), round(min(sub_2100)::double, 5)]) as minimum,
  unnest([round(max(dem)::double, 5), round(max(rate)::double, 5), round(max(sub_2050)::double, 5), round(max(sub_2100)::double, 5)]) as maximum from cells""")
def a3(spark, d):
    return rounded(areas.band_stats(fx.cells(spark, d), ["dem", "rate", "sub_2050", "sub_2100"]), 5)


@query("a4_weighted_area", SHARES + " select round(built_total, 5) as total, round(built_common, 5) as common from sh")
def a4(spark, d):
    frac = areas.domain_masks(fx.cells(spark, d)).join(_built(spark, d), ["row", "col"])
    return rounded(areas.weighted_area(frac, "fraction", fx.grid_of(spark, d), total=F.col("dem_valid_land"), common=F.col("common_analysis_land")), 5)


@query("a5_representativeness", SHARES + f" select {rs(*SHARE_NAMES, digits=4)} from sh")
def a5(spark, d):
    return rounded(_shares(spark, d), 4)


COVERAGE = f"""with {sql.CELLS}, {sql.AREA}, {UNITS},
cov as (select name as administrative_unit, 'ADM_2' as gadm_layer, sum(area_km2) filter (land) as land_area_km2, coalesce(sum(area_km2) filter (land and rate is not null and sub_2100 is not null), 0) as common_area_km2
  from inside join cells using (row, col) join ra using (row) group by 1 having count(*) filter (land) > 0)"""


def _coverage(spark, d):
    grid = fx.grid_of(spark, d)
    return zones.admin_coverage(fx.units(spark, d, grid), zones.cells_in_units(fx.unit_edges(spark, d, grid), grid), fx.cells(spark, d), grid)


@query("a6_admin_coverage", COVERAGE + " select administrative_unit, gadm_layer, round(land_area_km2, 6) as land_area_km2, round(common_area_km2, 6) as common_area_km2, round(common_area_km2 * 100 / land_area_km2, 4) as common_share_percent from cov")
def a6(spark, d):
    out = _coverage(spark, d)
    return out.select("administrative_unit", "gadm_layer", r("land_area_km2"), r("common_area_km2"), r("common_share_percent", 4)).orderBy(F.desc("land_area_km2"))


@query("a7_main_scenarios", MAIN + """ select scenario, year::int as year, added_water_m, water_level_egm2008_m, persistence, round(common_km2, 6) as common_domain_area_km2,
  round(b_km2, 6) as baseline_connected_area_km2, round(a_km2, 6) as subsidence_adjusted_area_km2, round(d_km2, 6) as subsidence_added_area_km2,
  round(b_people, 3) as baseline_population, round(a_people, 3) as subsidence_adjusted_population, round(a_people - b_people, 3) as subsidence_added_population from main""")
def a7(spark, d):
    m = _main(spark, d)
    return m.select(*m.columns[:5], *[r(c) for c in m.columns[5:9]], *[r(c, 3) for c in m.columns[9:]])


def _table_sql(rows, names: str, shown: str) -> str:
    """rows: described columns, baseline case, adjusted case."""
    cases: list = []
    for *_, b, a in rows:
        cases += [c for c in (b, a) if c not in cases]
    pairs = [(*x, cases.index(b), cases.index(a)) for *x, b, a in rows]
    return f"""with recursive {sql.CELLS}, {sql.floods(cases)}, {_pairs_sql(pairs, names)}, {PAIR_AREAS}
select {shown}, round(b_km2, 6) as baseline_area_km2, round(a_km2, 6) as continued_trend_area_km2, round(d_km2, 6) as subsidence_added_area_km2 from pa"""


TERRAIN = _table_sql(
    [(s.scenario, s.year, s.added_water_m, s.water_level_egm2008_m, o, (o, "none", s.water_level_egm2008_m, 8), (o, f"c{s.year}", s.water_level_egm2008_m, 8)) for o in sc.TERRAIN_OFFSETS for s in fx.SCENARIOS],
    "scenario, year, added_water_m, water_level_egm2008_m, uniform_dem_offset_m", "scenario, year::int as year, added_water_m, water_level_egm2008_m, uniform_dem_offset_m",
)
CONNECTIVITY = _table_sql(
    [(s.scenario, s.year, s.added_water_m, n, (0.0, "none", s.water_level_egm2008_m, n), (0.0, f"c{s.year}", s.water_level_egm2008_m, n)) for n in (4, 8) for s in fx.SCENARIOS],
    "scenario, year, added_water_m, neighbours", "scenario, year::int as year, added_water_m, neighbours::int as neighbours",
)
DATUM = _table_sql(
    [(o, BASE + o, (0.0, "none", BASE + o, 8), (0.0, "c2100", BASE + o, 8)) for o in (-lv.DATUM_CI95_M, 0.0, lv.DATUM_CI95_M)],
    "datum_offset_m, water_level_egm2008_m", "round(datum_offset_m, 9) as datum_offset_m, round(water_level_egm2008_m, 9) as water_level_egm2008_m",
)


@query("c4_edge_cells_tiles", f"""with {sql.CELLS}, m as (select row, col from cells where common)
select a.row, a.col from m a left join m b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2 having count(*) < 9""")
def c4_tiles(spark, d):
    return flood.edge_cells(fx.cells(spark, d).where("common"), tile=SMALL_TILE)


def _areas6(df: DataFrame) -> DataFrame:
    return df.select(*[r(c) if c.endswith("_km2") else F.col(c) for c in df.columns])


@query("a8_terrain_sensitivity", TERRAIN)
def a8(spark, d):
    return _areas6(sc.terrain_sensitivity(fx.cells(spark, d), fx.grid_of(spark, d), fx.SCENARIOS))


@query("a9_connectivity_sensitivity", CONNECTIVITY)
def a9(spark, d):
    return _areas6(sc.connectivity_sensitivity(fx.cells(spark, d), fx.grid_of(spark, d), fx.SCENARIOS))


@query("a9_connectivity_sensitivity_tiles", CONNECTIVITY)
def a9_tiles(spark, d):
    return _areas6(sc.connectivity_sensitivity(fx.cells(spark, d), fx.grid_of(spark, d), fx.SCENARIOS, tile=SMALL_TILE))


def _datum(spark, d, **how):
    out = sc.datum_sensitivity(fx.cells(spark, d), fx.grid_of(spark, d), fx.TARGET, **how)
    return out.select(r("datum_offset_m", 9), r("water_level_egm2008_m", 9), *[r(c) for c in out.columns if c.endswith("_km2")])


@query("a10_datum_sensitivity", DATUM)
def a10(spark, d):
    return _datum(spark, d)


@query("a10_datum_sensitivity_tiles", DATUM)
def a10_tiles(spark, d):
    return _datum(spark, d, tile=SMALL_TILE)


#: Consecutive site numbers whose distances share a map.
SITES_A_MAP = 1024


def _grouped(spark, d):
    s = zones.nearest_pixel(fx.sites(spark, d), fx.cells(spark, d), fx.grid_of(spark, d)).withColumn("set", F.col("site") % 7)
    s = s.withColumn("block", F.floor(F.col("site") / SITES_A_MAP))
    entry = F.struct(F.col("site").cast("string").alias("k"), F.round("distance_m", 6).alias("v"))
    return s.groupBy("set", "block").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("distances"))


@query("a12_site_distances", f"""with {sql.CELLS}, {SITES} select site % 7 as set, round(min(distance_m), 4) as minimum_m, round(max(distance_m), 4) as maximum_m,
  round(avg(distance_m), 4) as mean_m, round(median(distance_m), 4) as median_m from sd group by 1""")
def a12(spark, d):
    return rounded(st.site_distance_summary(_grouped(spark, d)), 4)


PAIRS = "pr as (select l_suppkey as site, l_quantity as a, l_extendedprice / 1000 as b, (l_shipdate::date - date '1992-01-01') / 365.25::double - 3.5::double as t from lineitem)"


@query("a13_site_consistency", f"with {PAIRS} select site, count(*) as n, round(corr(a, b), 6) as r, round(sqrt(avg((a - b) * (a - b))), 6) as rmse from pr group by 1")
def a13(spark, d):
    return rounded(st.site_consistency(fx.pairs(spark, d)))


def _det(m):
    (a, b, c), (e, f, g), (h, i, j) = m
    return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {c} * ({e} * {i} - {f} * {h}))"


_M = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
_SOLVED = ", ".join(f"round({_det([[f'q{i}' if j == k else _M[i][j] for j in range(3)] for i in range(3)])} / {_det(_M)}, 4) as c{k}" for k in range(3))


@query("a14_site_trend", f"""with {PAIRS}, s as (select site, count(*)::double as s0, {', '.join(f'sum(pow(t, {k})) as s{k}' for k in range(1, 5))}, {', '.join(f'sum(b * pow(t, {k})) as q{k}' for k in range(3))} from pr group by 1)
select site, s0::bigint as n, {_SOLVED} from s""")
def a14(spark, d):
    return rounded(st.site_trend(fx.pairs(spark, d).withColumnRenamed("b", "y")), 4)


_YEARS = PAIRS.replace("/ 365.25::double - 3.5::double as t", "/ 365.25::double + 1992 as t")
_PUT = ", ".join(f"sum(pow(u, {k})) as s{k}" for k in range(1, 5)) + ", " + ", ".join(f"sum(b * pow(u, {k})) as q{k}" for k in range(3))
_B = ", ".join(f"{_det([[f'q{i}' if j == k else _M[i][j] for j in range(3)] for i in range(3)])} / {_det(_M)} as b{k}" for k in range(3))


@query("a14_site_trend_years", f"""with {_YEARS}, ends as (select site, (min(t) + max(t)) / 2 as mid, (max(t) - min(t)) / 2 as half from pr group by 1),
s as (select site, mid, half, count(*)::double as s0, {_PUT} from (select *, (t - mid) / half as u from pr join ends using (site)) group by 1, 2, 3),
b as (select site, s0, half, (mid - 1995) / half as m, {_B} from s)
select site, s0::bigint as n, round(b0 - b1 * m + b2 * m * m, 6) as c0, round((b1 - 2 * b2 * m) / half, 6) as c1, round(b2 / (half * half), 6) as c2 from b""")
def a14_years(spark, d):
    years = fx.pairs(spark, d).select("site", F.col("b").alias("y"), (F.col("t") + 3.5 + 1992).alias("t"))
    return rounded(st.site_trend(years, 1995.0))


@query("a15_bootstrap_rmse", f"""with {PAIRS}, re as (select site, a - b as e, row_number() over (partition by site order by a - b) - 1 as i from pr),
n as (select site, count(*) as n from re group by 1),
dr as (select site, rep, n, unnest(range(n)) as k from n, range(1, 21) t(rep)),
pk as (select site, rep, ('0x' || substr(md5(concat_ws('|', '1', site::varchar, rep::varchar, k::varchar)), 1, 8))::bigint % n as i from dr),
ea as (select pk.site, rep, sqrt(avg(e * e)) as rmse from pk join re on re.site = pk.site and re.i = pk.i group by 1, 2)
select site, round(quantile_cont(rmse, 0.025), 6) as rmse_low, round(quantile_cont(rmse, 0.975), 6) as rmse_high from ea group by 1""")
def a15(spark, d):
    e = fx.pairs(spark, d).select("site", (F.col("a") - F.col("b")).alias("e"))
    resid = e.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("e")).cast("long") - 1)
    return rounded(st.bootstrap_rmse(resid))


# --- priorities


NINE = pr.cases_of(BASE)
PRIORITY = f"""with recursive {sql.CELLS}, {sql.POPULATION}, {sql.DENSITY}, {sql.floods([(o, 'none', h + pr.REACH_M, 8) for o, _, h in NINE])},
lp as (select row, col, ln(1 + density::double)::float as lp from dens),
scales as (select quantile_cont(rate_clean::double, 0.95)::float as rate_p95, quantile_cont(lp::double, 0.99)::float as pop_log_p99 from cells join lp using (row, col) where common),
nine(k, off, h) as (values {', '.join(f'({k}, {o!r}::float, {h!r}::double)' for k, (o, _, h) in enumerate(NINE))}),
norm as (select row, col, common, dem, case when rate_p95 > 0 then least(greatest((rate_clean / rate_p95)::float, 0::float), 1::float) else 0::float end as s,
  case when pop_log_p99 > 0 then least(greatest((lp / pop_log_p99)::float, 0::float), 1::float) else 0::float end as p from cells join lp using (row, col), scales),
pri as (select k, row, col, ((s * least(greatest(1::float - (abs((dem + off) - h::float) / 0.5::float)::float, 0::float), 1::float))::float * p)::float as priority
  from fl join norm using (row, col) join nine using (k) where norm.common),
cut as (select k, quantile_cont(priority::double, 0.9)::float as cut from pri where priority > 0 group by 1),
hot as (select k, row, col from pri join cut using (k) where priority >= cut),
rec as (select row, col, count(*) as hits from hot group by 1, 2)"""


def _priority(spark, d):
    return pr.priority_cases(_dense(spark, d), fx.grid_of(spark, d), BASE)


def _hot(spark, d):
    found = Scratch(spark).save(_priority(spark, d)[0])
    return found, pr.hot_flags(found, pr.cutoffs(found, 9))


@query("a11_recurrence", PRIORITY + f", {sql.AREA} select row, col, hits::int as hits, round(hits / 9::double, 5) as frequency from rec")
def a11(spark, d):
    return rounded(pr.recurrence(_hot(spark, d)[1]), 5)


@query("r1_rate_norm", PRIORITY + " select row, col, round(s::double, 5) as s from norm")
def r1(spark, d):
    cells = fx.cells(spark, d)
    scale = pr.scale_of(cells, F.col("rate_clean"), 0.95, F.col("common"))
    return rounded(cells.select("row", "col", pr.normalise_p(F.col("rate_clean"), scale).alias("s")), 5)


@query("r2_population_norm", PRIORITY + " select row, col, round(p::double, 4) as p from norm")
def r2(spark, d):
    cells, log = Scratch(spark).save(_dense(spark, d)), F.log1p(F.col("density").cast("double")).cast("float")
    return rounded(cells.select("row", "col", pr.normalise_p(log, pr.scale_of(cells, log, 0.99, F.col("common"))).alias("p")), 4)


@query("r3_threshold_proximity", f"with {sql.CELLS} select row, col, round(least(greatest(1::float - (abs(dem - {BASE!r}::float) / 0.5::float)::float, 0::float), 1::float)::double, 5) as t from cells where dem is not null")
def r3(spark, d):
    return rounded(fx.cells(spark, d).where("dem is not null").select("row", "col", lv.threshold_proximity(F.col("dem"), BASE).alias("t")), 5)


@query("r4_priority_index", PRIORITY + " select row, col, round(priority::double, 4) as priority from pri where k = 4")
def r4(spark, d):
    found = pr.priority_cases(_dense(spark, d), fx.grid_of(spark, d), BASE, [NINE[4]])[0]
    return rounded(found.select("row", "col", F.col("priority")[0].alias("priority")), 4)


@query("s7_write_priority_layers", PRIORITY + """ select c.row, c.col, case when c.common then round(coalesce(priority::double, 0), 4) else -9999 end as priority, case when c.common then round(coalesce(hits, 0) / 9::double, 5) else -9999 end as frequency
  from cells c left join pri on pri.k = 4 and pri.row = c.row and pri.col = c.col left join rec on rec.row = c.row and rec.col = c.col""")
def s7_priority(spark, d):
    cells = fx.cells(spark, d)
    found, hot = _hot(spark, d)
    top = found.select("row", "col", F.col("priority")[4].alias("value"))
    path = Scratch(spark).root
    bands.write_layer(pr.on_grid(cells, top, "value"), F.col("value"), F.col("common"), f"{path}/priority")
    bands.write_layer(pr.on_grid(cells, pr.recurrence(hot), "frequency"), F.col("frequency"), F.col("common"), f"{path}/frequency")
    back = [spark.read.parquet(f"{path}/{n}").withColumnRenamed("value", n) for n in ("priority", "frequency")]
    return back[0].join(back[1], ["row", "col"]).select("row", "col", r("priority", 4), r("frequency", 5))


@query("r5_priority_cases", PRIORITY + """ select k::int as k, row, col, round(coalesce(priority::double, 0), 4) as priority
  from (select distinct row, col from pri) cross join nine left join pri using (k, row, col)""")
def r5(spark, d):
    return rounded(_priority(spark, d)[0].select("row", "col", F.posexplode("priority").alias("k", "priority")), 4)


@query("r6_top_decile", PRIORITY + " select k::int as k, row, col from hot")
def r6(spark, d):
    return _hot(spark, d)[1].select("row", "col", F.posexplode("hot").alias("k", "hot")).where("hot").select("k", "row", "col")


@query("r7_priority_summary", PRIORITY + f""", {sql.AREA} select {BASE!r}::double as target_water_level_egm2008_m, (select round(cut::double, 4) from cut where k = 4) as central_top_decile_cutoff,
  (select round(coalesce(sum(area_km2), 0), 5) from hot join ra using (row) where k = 4) as central_top_decile_area_km2,
  (select round(coalesce(sum(area_km2), 0), 5) from rec join ra using (row) where hits * 3 >= 18) as robust_area_km2, (select round(coalesce(sum(area_km2), 0), 5) from rec join ra using (row) where hits * 3 >= 9) as moderate_area_km2,
  (select round(max(hits) / 9::double, 5) from rec) as maximum_frequency, round(rate_p95::double, 5) as rate_p95, round(pop_log_p99::double, 4) as pop_log_p99, 9 as sensitivity_cases from scales""")
def r7(spark, d):
    s = pr.priority_summary(_dense(spark, d), fx.grid_of(spark, d), BASE)
    four = {"central_top_decile_cutoff", "pop_log_p99"}
    return s.select("target_water_level_egm2008_m", *[r(c, 4 if c in four else 5) for c in s.columns[1:-1]], "sensitivity_cases")


@query("r8_top_units", COVERAGE + " select administrative_unit, round(common_area_km2, 6) as common_area_km2 from cov where common_area_km2 > 0.001 order by cov.common_area_km2 desc, administrative_unit limit 6")
def r8(spark, d):
    return zones.top_units(_coverage(spark, d), 6, 0.001).select("administrative_unit", r("common_area_km2"))


@query("r9_sensitivity_view", MAIN + """ select persistence, case persistence when 'stabilisation' then 1 when 'decaying_trend' then 2 else 3 end::bigint as place, round(a_km2, 6) as subsidence_adjusted_area_km2
  from main where scenario = 'SSP5-8.5' and year = 2100 and added_water_m = 0""")
def r9(spark, d):
    place = sc.persistence_order(F.col("persistence"))
    out = sc.sensitivity_view(_main(spark, d), place)
    return out.select("persistence", place.cast("long").alias("place"), r("subsidence_adjusted_area_km2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline, adjusted and added area of the target scenario."""
    plan = sc.FloodPlan()
    b = plan.case("dem", lv.adjusted_surface(F.col("dem"), F.lit(0.0)), BASE)
    plan.pair(b, plan.case("sub", lv.adjusted_surface(F.col("dem"), F.col("sub_2100_clean")), BASE), level=BASE)
    grid = fx.grid_of(spark, sf_dir)
    return plan.areas(plan.runs(fx.cells(spark, sf_dir), grid), grid).drop("pair")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
