"""Column functions of scenarios, subsidence and water levels. Rasters stay 32-bit floats, as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERSISTENCE = ("stabilisation", "decaying_trend", "continued_trend")
#: Largest subsidence of the decaying trend by target year, m.
CAPS = {2050: 1.5, 2100: 3.0}
START_YEAR, END_YEAR = 2025, 2100
DATUM_CI95_M = 0.116600812
CD_TO_EGM_M = -0.534


def clean_subsidence(v: Column) -> Column:
    """Missing and negative subsidence is none."""
    return F.greatest(F.coalesce(v, F.lit(0.0).cast("float")), F.lit(0.0).cast("float")).cast("float")


def decaying_effective_years(year: Column, start: int = START_YEAR, end: int = END_YEAR) -> Column:
    """Years at today's rate that equal a rate falling linearly to zero from start to end."""
    horizon = float(end - start)
    t = F.least(F.greatest(year.cast("double") - start, F.lit(0.0)), F.lit(horizon))
    return t - t * t / (2 * horizon)


def decayed_years(year: int, start: int = START_YEAR, end: int = END_YEAR) -> float:
    horizon = float(end - start)
    t = min(max(float(year - start), 0.0), horizon)
    return t - t * t / (2 * horizon)


def subsidence_by(persistence: str, year: int, rate: Column, continued: Column) -> Column:
    """Subsidence at a year under one assumption, from the cleaned rate and the cleaned continued layer."""
    if persistence == "stabilisation":
        return F.lit(0.0).cast("float")
    if persistence == "decaying_trend":
        return F.least(rate.cast("float") * F.lit(decayed_years(year)).cast("float"), F.lit(CAPS[year]).cast("float"))
    if persistence == "continued_trend":
        return continued.cast("float")
    raise ValueError(persistence)


def persistence_subsidence(cells: DataFrame, year: int) -> DataFrame:
    """(row, col, persistence, sub): the three assumptions as rows."""
    kinds = [F.struct(F.lit(p).alias("persistence"), subsidence_by(p, year, F.col("rate"), F.col(f"sub_{year}")).alias("sub")) for p in PERSISTENCE]
    return cells.select("row", "col", F.inline(F.array(*kinds)))


def adjusted_surface(dem: Column, sub: Column, offset: float = 0.0) -> Column:
    """(dem + offset) - sub, in this order, in 32-bit floats."""
    return (dem.cast("float") + F.lit(offset).cast("float")) - sub.cast("float")


def water_levels(base: DataFrame, rise: DataFrame, added: DataFrame) -> DataFrame:
    """Total level of each scenario, year and added water: datum base + sea-level rise + added. All three are a few rows."""
    total = F.col("h0_m") + F.col("rise_m") + F.col("added_water_m")
    return base.crossJoin(rise).crossJoin(added).select("scenario", "year", "added_water_m", total.alias("water_level_egm2008_m"))


def event_levels(events: DataFrame, cd_to_egm: float = CD_TO_EGM_M) -> DataFrame:
    """Adds residual (total less tide) and peak above EGM2008, from levels above chart datum."""
    return events.withColumn("residual_m", F.col("total_level_m_cd") - F.col("tide_m_cd")).withColumn("peak_m_egm2008", F.col("total_level_m_cd") + cd_to_egm)


def case_id(scenario: Column, year: Column, added: Column) -> Column:
    text = F.concat(F.translate(scenario, ".-", "pm"), F.lit("_"), year.cast("string"), F.lit("_added"), F.format_string("%.1f", added.cast("double")), F.lit("m"))
    return F.translate(text, ".", "p")


def is_close(a: Column, b: Column | float) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def pick_cases(df: DataFrame, scenario: str, year: int, added: float, persistence: str | None = None) -> DataFrame:
    out = df.where((F.col("scenario") == scenario) & (F.col("year") == year) & is_close(F.col("added_water_m"), added))
    return out if persistence is None else out.where(F.col("persistence") == persistence)


def report_rounding(df: DataFrame) -> DataFrame:
    """Areas to 1 km2, populations to 0.01 million, levels to 0.01 m, by name; halves to even."""
    out = []
    for c in df.columns:
        if c.endswith("area_km2"):
            out.append(F.bround(F.col(c), 0).alias(c))
        elif c.endswith("population"):
            out.append(F.bround(F.col(c) / 1e6, 2).alias(f"{c}_million"))
        elif "level" in c:
            out.append(F.bround(F.col(c), 2).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def parse_interval(text: Column) -> tuple[Column, Column, Column]:
    """(value, low, high) of "48.7 (45.2–52.3)"; nulls where the text is not of that form."""
    form = r"^\s*(-?[0-9.]+)\s*\(\s*(-?[0-9.]+)\s*–\s*(-?[0-9.]+)\s*\)\s*$"
    return tuple(F.regexp_extract(text, form, i).try_cast("double") for i in (1, 2, 3))


def threshold_proximity(dem: Column, level: float, width: float = 0.5) -> Column:
    """1 at the level, falling to 0 at ``width`` above or below; 32-bit floats."""
    f = lambda v: F.lit(v).cast("float")
    near = f(1.0) - (F.abs(dem.cast("float") - f(level)) / f(width)).cast("float")
    return F.least(F.greatest(near, f(0.0)), f(1.0))
