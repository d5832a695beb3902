"""Scenario tables: areas and exposed people under persistence, terrain, connectivity and datum assumptions.

Each table asks for all its floods in one call, so cells are shuffled to tiles once, and a scenario's baseline is
flooded once for all assumptions that share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import DATUM_CI95_M, PERSISTENCE, adjusted_surface, pick_cases, subsidence_by
from ..grid import GridSpec
from ..operators.areas import mask_area
from ..operators.flood import Case
from ..operators.runs import run_area, run_overlap
from ..operators.spill import flood_runs, same_masks
from ..scratch import Scratch

TERRAIN_OFFSETS = (-1.0, -0.5, 0.0, 0.5, 1.0)


class FloodPlan:
    """Distinct surfaces and cases, and pairs (baseline, adjusted) with the columns that describe them."""

    def __init__(self):
        self.surfaces: dict = {}
        self.cases: list[Case] = []
        self.pairs: list[tuple[int, int, dict]] = []

    def case(self, name: str, surface, water: float, neighbours: int = 8) -> int:
        self.surfaces.setdefault(name, surface)
        case = Case(name, water, neighbours)
        if case not in self.cases:
            self.cases.append(case)
        return self.cases.index(case)

    def pair(self, baseline: int, adjusted: int, **described) -> None:
        self.pairs.append((baseline, adjusted, described))

    def names(self, spark, kinds: str) -> DataFrame:
        return spark.createDataFrame([(i, *d.values()) for i, (_, _, d) in enumerate(self.pairs)], f"pair int, {kinds}")

    def runs(self, cells: DataFrame, grid: GridSpec, shifts: dict[str, tuple[str, float]] | None = None, **how) -> DataFrame:
        """(mask, row, start, stop) of the common domain: mask k is case k, mask len(cases) + i what pair i's adjusted flood adds.

        shifts: surfaces that are another one raised by an offset, but for rounding. Where water lowered by the offset leaves the
        same land low on the other surface, its levels serve, and the surface gets none of its own.
        """
        cases, surfaces = list(self.cases), self.surfaces
        moved = [(k, Case(shifts[c.surface][0], c.water - shifts[c.surface][1], c.neighbours)) for k, c in enumerate(cases) if shifts and c.surface in shifts]
        if moved:
            same = same_masks(cells, surfaces, [((cases[k].surface, cases[k].water), (c.surface, c.water)) for k, c in moved])
            for (k, c), equal in zip(moved, same):
                cases[k] = c if equal else cases[k]
            surfaces = {n: s for n, s in surfaces.items() if n in {c.surface for c in cases}}
        return flood_runs(cells, grid, surfaces, cases, [(a, b) for b, a, _ in self.pairs], "common", **how)

    def areas(self, runs: DataFrame, grid: GridSpec) -> DataFrame:
        """(pair, baseline_km2, adjusted_km2, added_km2) of all pairs; a mask without cells has area 0."""
        spark, n = runs.sparkSession, len(self.cases)
        sides = [(i, m, side) for i, (b, a, _) in enumerate(self.pairs) for side, m in (("baseline_km2", b), ("adjusted_km2", a), ("added_km2", n + i))]
        keyed = spark.createDataFrame(sides, "pair int, mask int, side string").join(run_area(runs, grid), "mask", "left")
        of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("area_km2"))), F.lit(0.0)).alias(side)
        return keyed.groupBy("pair").agg(*[of(s) for s in ("baseline_km2", "adjusted_km2", "added_km2")])


def main_plan(scenarios: list) -> FloodPlan:
    """scenarios: rows of scenario, year, added_water_m, water_level_egm2008_m (a dozen)."""
    plan = FloodPlan()
    dem, zero = F.col("dem"), F.lit(0.0).cast("float")
    for s in scenarios:
        base = plan.case("dem", adjusted_surface(dem, zero), s.water_level_egm2008_m)
        for p in PERSISTENCE:
            sub = subsidence_by(p, s.year, F.col("rate_clean"), F.col(f"sub_{s.year}_clean"))
            name = "dem" if p == "stabilisation" else f"{p}_{s.year}"
            case = plan.case(name, adjusted_surface(dem, sub), s.water_level_egm2008_m)
            plan.pair(base, case, scenario=s.scenario, year=s.year, added=s.added_water_m, level=s.water_level_egm2008_m, persistence=p)
    return plan


def pop_scenario(scenario):
    return F.when(scenario.startswith("SSP2"), "SSP2").otherwise("SSP5")


def main_scenarios(cells: DataFrame, grid: GridSpec, scenarios: list, population: DataFrame, pop_grid: GridSpec, **how) -> DataFrame:
    """Areas and exposed people of every scenario under the three persistence assumptions.

    cells: dem, land, common, rate_clean, sub_<year>_clean. population: pop_scenario, year, prow, pcol, population.
    """
    spark = cells.sparkSession
    plan = main_plan(scenarios)
    runs = Scratch(spark).save(plan.runs(cells, grid, **how))  # read for areas and for people
    names = plan.names(spark, "scenario string, year int, added_water_m double, water_level_egm2008_m double, persistence string")
    names = names.withColumn("pop_scenario", pop_scenario(F.col("scenario")))
    areas = plan.areas(runs, grid)
    # people by distinct flood: a case is resampled once, whatever pairs it is part of
    fraction = run_overlap(runs.where(F.col("mask") < len(plan.cases)), grid, pop_grid).withColumnRenamed("mask", "case")
    valid = population.where("population >= 0 and not isnan(population)").withColumnsRenamed({"prow": "drow", "pcol": "dcol", "year": "pop_year"})
    sides = [(i, k, side) for i, (b, a, _) in enumerate(plan.pairs) for k, side in ((b, "b"), (a, "a"))]
    keyed = spark.createDataFrame(sides, "pair int, case int, side string").join(names.select("pair", "pop_scenario", F.col("year").alias("pop_year")), "pair")
    asked = F.broadcast(keyed.select("case", "pop_scenario", "pop_year").distinct())  # one row a case and population
    people = fraction.join(asked, "case").join(valid, ["pop_scenario", "pop_year", "drow", "dcol"])
    people = people.groupBy("case", "pop_scenario", "pop_year").agg(F.sum(F.col("population") * F.col("fraction")).alias("people"))
    exposed = keyed.join(people, ["case", "pop_scenario", "pop_year"]).groupBy("pair").agg(
        F.sum(F.when(F.col("side") == "b", F.col("people")).otherwise(0.0)).alias("baseline_population"),
        F.sum(F.when(F.col("side") == "a", F.col("people")).otherwise(0.0)).alias("subsidence_adjusted_population"),
    )
    common = mask_area(cells.where("common"), grid).select(F.col("area_km2").alias("common_domain_area_km2"))
    out = names.join(areas, "pair").join(exposed, "pair", "left").fillna(0.0, ["baseline_population", "subsidence_adjusted_population"]).crossJoin(common)
    return out.select(
        "scenario", "year", "added_water_m", "water_level_egm2008_m", "persistence", "common_domain_area_km2",
        F.col("baseline_km2").alias("baseline_connected_area_km2"), F.col("adjusted_km2").alias("subsidence_adjusted_area_km2"),
        F.col("added_km2").alias("subsidence_added_area_km2"), "baseline_population", "subsidence_adjusted_population",
        (F.col("subsidence_adjusted_population") - F.col("baseline_population")).alias("subsidence_added_population"),
    )


def _sensitivity(plan: FloodPlan, cells: DataFrame, grid: GridSpec, kinds: str, **how) -> DataFrame:
    names = plan.names(cells.sparkSession, kinds)
    out = names.join(plan.areas(plan.runs(cells, grid, **how), grid), "pair").drop("pair")
    return out.withColumnsRenamed({"baseline_km2": "baseline_area_km2", "adjusted_km2": "continued_trend_area_km2", "added_km2": "subsidence_added_area_km2"})


def terrain_sensitivity(cells: DataFrame, grid: GridSpec, scenarios: list, offsets=TERRAIN_OFFSETS, **how) -> DataFrame:
    """A uniform offset of the terrain moves levels with it, but for rounding; surfaces whose low land it leaves the same are not labelled again."""
    plan, dem, zero, shifts = FloodPlan(), F.col("dem"), F.lit(0.0).cast("float"), {}
    for o in sorted(offsets, key=abs):
        for s in scenarios:
            if o:
                shifts |= {f"dem_{o}": ("dem_0.0", o), f"sub_{s.year}_{o}": (f"sub_{s.year}_0.0", o)}
            b = plan.case(f"dem_{o}", adjusted_surface(dem, zero, o), s.water_level_egm2008_m)
            a = plan.case(f"sub_{s.year}_{o}", adjusted_surface(dem, F.col(f"sub_{s.year}_clean"), o), s.water_level_egm2008_m)
            plan.pair(b, a, scenario=s.scenario, year=s.year, added=s.added_water_m, level=s.water_level_egm2008_m, offset=o)
    return _sensitivity(plan, cells, grid, "scenario string, year int, added_water_m double, water_level_egm2008_m double, uniform_dem_offset_m double", shifts=shifts if 0.0 in offsets else None, **how)


def connectivity_sensitivity(cells: DataFrame, grid: GridSpec, scenarios: list, **how) -> DataFrame:
    plan, dem, zero = FloodPlan(), F.col("dem"), F.lit(0.0).cast("float")
    for n in (4, 8):
        for s in scenarios:
            b = plan.case("dem", adjusted_surface(dem, zero), s.water_level_egm2008_m, n)
            a = plan.case(f"sub_{s.year}", adjusted_surface(dem, F.col(f"sub_{s.year}_clean")), s.water_level_egm2008_m, n)
            plan.pair(b, a, scenario=s.scenario, year=s.year, added=s.added_water_m, neighbours=n)
    return _sensitivity(plan, cells, grid, "scenario string, year int, added_water_m double, neighbours int", **how)


def datum_sensitivity(cells: DataFrame, grid: GridSpec, target, ci: float = DATUM_CI95_M, **how) -> DataFrame:
    plan, dem, zero = FloodPlan(), F.col("dem"), F.lit(0.0).cast("float")
    for o in (-ci, 0.0, ci):
        level = target.water_level_egm2008_m + o
        b = plan.case("dem", adjusted_surface(dem, zero), level)
        a = plan.case("sub", adjusted_surface(dem, F.col(f"sub_{target.year}_clean")), level)
        plan.pair(b, a, offset=o, level=level)
    return _sensitivity(plan, cells, grid, "datum_offset_m double, water_level_egm2008_m double", **how)


def scenario_source(main: DataFrame, year: int) -> DataFrame:
    """The year's rows under the continued trend, with the difference to the baseline."""
    out = main.where((F.col("year") == year) & (F.col("persistence") == "continued_trend"))
    return out.select(
        "scenario", "year", "added_water_m", "water_level_egm2008_m", "baseline_connected_area_km2",
        F.col("subsidence_adjusted_area_km2").alias("continued_trend_connected_area_km2"),
        (F.col("subsidence_adjusted_area_km2") - F.col("baseline_connected_area_km2")).alias("difference_km2"),
    )


def persistence_order(name):
    """0, 1, 2 in the order stabilisation, decaying, continued; unknown names last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, PERSISTENCE)), name), F.lit(0)) + F.when(name.isin(*PERSISTENCE), 0).otherwise(len(PERSISTENCE) + 1)


def sensitivity_view(table: DataFrame, order_by, scenario: str = "SSP5-8.5", year: int = 2100, added: float = 0.0) -> DataFrame:
    """Rows of one target in a given order."""

    return pick_cases(table, scenario, year, added).orderBy(order_by)
