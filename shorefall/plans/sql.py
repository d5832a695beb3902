"""Common table expressions of the SQL that the queries are held against."""

from __future__ import annotations

import math

from ..functions.levels import decayed_years
from ..grid import ECCENTRICITY_2, SEMI_MAJOR_M
from . import fixtures as fx

BANDS = """
b0 as (select (event_id // 100)::int as row, (event_id % 100)::int as col,
    case when event_type = 'signup' and value > 150 then (-9999)::float else (value / 25.0::double)::float end as dem,
    case when event_id % 100 < 8 or (event_type = 'error' and event_id % 7 = 0) then 0 else 1 end as land_raw,
    case when event_type = 'view' and event_id % 3 = 0 then (-9999)::float else ((user_id % 150)::double / 3000.0::double)::float end as rate
  from events),
bands as (select *,
    case when rate = -9999 then (-9999)::float else least(rate::double * 25, 1.5::double)::float end as sub_2050,
    case when rate = -9999 then (-9999)::float else least(rate::double * 75, 3.0::double)::float end as sub_2100 from b0)"""

CELLS = BANDS + """,
c0 as (select row, col, nullif(dem, (-9999)::float) as dem, land_raw, nullif(rate, (-9999)::float) as rate,
    nullif(sub_2050, (-9999)::float) as sub_2050, nullif(sub_2100, (-9999)::float) as sub_2100 from bands),
cells as (select *, land_raw > 0 and dem is not null as land,
    land_raw > 0 and dem is not null and rate is not null and sub_2050 is not null and sub_2100 is not null as common,
    greatest(coalesce(rate, 0), 0)::float as rate_clean, greatest(coalesce(sub_2050, 0), 0)::float as sub_2050_clean,
    greatest(coalesce(sub_2100, 0), 0)::float as sub_2100_clean from c0),
size as (select max(row) + 1 as nrows, 100 as ncols from cells)"""


def strip(lat: str) -> str:
    e = math.sqrt(ECCENTRICITY_2)
    s = f"sin({lat})"
    return f"({1 - ECCENTRICITY_2!r}::double * ({s} / (2 * (1 - {ECCENTRICITY_2!r}::double * {s} * {s})) + atanh({e!r}::double * {s}) / {2 * e!r}::double))"


def row_area(name: str = "ra", y0: float = fx.Y0, dy: float = -fx.STEP, dx: float = fx.STEP, nrows: str = "(select nrows from size)") -> str:
    width = SEMI_MAJOR_M**2 * abs(math.radians(dx)) / 1e6
    edge = lambda r: f"radians({y0!r}::double + {dy!r}::double * ({r}))"
    return f"{name} as (select r::int as row, abs({strip(edge('r + 1'))} - {strip(edge('r'))}) * {width!r}::double as area_km2 from range({nrows}) t(r))"


AREA = row_area()


def floods(cases: list[tuple[float, str, float, int]]) -> str:
    """Connected floods of cases (offset, subsidence, level, neighbours) as fl(k, row, col, common)."""
    values = ", ".join(f"({k}, {o!r}::float, '{s}', {w!r}::double, {n})" for k, (o, s, w, n) in enumerate(cases))
    d50, d00 = decayed_years(2050), decayed_years(2100)
    return f"""fc(k, off, sub, water, nb) as (values {values}),
surf as (select k, row, col, common, land, nb, dem is not null as valid,
    (dem + off) - (case sub when 'c2050' then sub_2050_clean when 'c2100' then sub_2100_clean
      when 'd2050' then least(rate_clean * {d50!r}::float, 1.5::float) when 'd2100' then least(rate_clean * {d00!r}::float, 3.0::float)
      else 0::float end)::float <= water::float as under from cells, fc),
dom as (select k, row, col, common, nb, valid and land and under as low from surf where valid and (not land or under)),
ways as (select a as dr, b as dc from (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b) where a <> 0 or b <> 0),
reach(k, row, col) as (
  select k, row, col from dom, size where not low and (row = 0 or row = nrows - 1 or col = 0 or col = ncols - 1)
  union
  select d.k, d.row, d.col from (select r.k, r.row + dr as row, r.col + dc as col, dr * dc as slant from reach r, ways) n
    join dom d on d.k = n.k and d.row = n.row and d.col = n.col where d.nb = 8 or n.slant = 0),
fl as (select d.k, d.row, d.col, d.common from dom d join reach r on d.k = r.k and d.row = r.row and d.col = r.col where d.low)"""


def overlap(name: str, src0: float, dsrc: float, nsrc: str, dst0: float, ddst: float, ndst: str) -> str:
    return f"""{name}0 as (select r::int as src, ({src0!r}::double + {dsrc!r}::double * r - {dst0!r}::double) / {ddst!r}::double as u,
    ({src0!r}::double + {dsrc!r}::double * (r + 1) - {dst0!r}::double) / {ddst!r}::double as v from range({nsrc}) t(r)),
{name}1 as (select src, u, v, unnest(range(floor(u)::bigint, floor(v)::bigint + 1))::int as dst from {name}0),
{name} as (select src, dst, least(v, dst + 1) - greatest(u, dst) as w from {name}1
  where least(v, dst + 1) - greatest(u, dst) > 1e-9 and dst between 0 and {ndst} - 1)"""


POP_ROWS = "(select max(c_custkey) // 36 + 1 from customer)"
CLASS_ROWS = "(select max(o_orderkey) // 122 + 1 from orders)"
POPULATION = (
    "variants(pop_scenario, year, factor) as (values "
    + ", ".join(f"('{s}', {y}, {f!r}::double)" for s, y, f in fx.POP_VARIANTS)
    + "),\npop as (select pop_scenario, year, (c_custkey // 36)::int as prow, (c_custkey % 36)::int as pcol, c_acctbal * factor as population from customer, variants)"
)
#: Fine grid to population grid.
TO_POP = (
    overlap("px", fx.X0, fx.STEP, "100", fx.X0, fx.POP_STEP, "36")
    + ",\n"
    + overlap("py", fx.Y0, -fx.STEP, "(select nrows from size)", fx.Y0, -fx.POP_STEP, POP_ROWS)
    + ",\npsx as (select dst, sum(w) as s from px group by dst), psy as (select dst, sum(w) as s from py group by dst)"
)
#: Class grid to fine grid.
TO_CELLS = (
    overlap("kx", fx.X0, fx.CLASS_STEP, "122", fx.X0, fx.STEP, "100")
    + ",\n"
    + overlap("ky", fx.Y0, -fx.CLASS_STEP, CLASS_ROWS, fx.Y0, -fx.STEP, "(select nrows from size)")
    + ",\nksx as (select dst, sum(w) as s from kx group by dst), ksy as (select dst, sum(w) as s from ky group by dst)"
)


def fraction(mask: str, axes: str, by: str = "") -> str:
    """Select of by, drow, dcol, fraction from a table of true cells."""
    keys = by + ", " if by else ""
    group = ", ".join(str(i + 1) for i in range(by.count(",") + 3 if by else 2))
    return f"""select {keys}y.dst as drow, x.dst as dcol, least(greatest(sum(x.w * y.w) / (any_value(sx.s) * any_value(sy.s)), 0), 1) as fraction
  from {mask} m join {axes}x x on m.col = x.src join {axes}y y on m.row = y.src
  join {axes}sx sx on sx.dst = x.dst join {axes}sy sy on sy.dst = y.dst group by {group}"""


def class_tile(tile: int | None = None) -> str:
    own = "case when o_orderpriority = '1-URGENT' then 50 else 10 end"
    if tile is not None:
        own = f"case when o_orderkey % 2 = {tile} then {own} else 0 end"
    return f"select (o_orderkey // 122)::int as row, (o_orderkey % 122)::int as col, {own} as class from orders"


#: Bilinear population density of SSP2 2020 on the fine grid: dens(row, col, density).
DENSITY = row_area("pra", fx.Y0, -fx.POP_STEP, fx.POP_STEP, POP_ROWS) + f""",
pd as (select prow, pcol, (coalesce(case when population >= 0 then population::float end, 0)::double / area_km2)::float as density
  from pop join pra on pra.row = prow where pop_scenario = 'SSP2' and year = 2020),
bx0 as (select r::int as dst, ({fx.X0!r}::double + {fx.STEP!r}::double * (r + 0.5::double) - {fx.X0!r}::double) / {fx.POP_STEP!r}::double - 0.5::double as u from range(100) t(r)),
by0 as (select r::int as dst, ({fx.Y0!r}::double + {-fx.STEP!r}::double * (r + 0.5::double) - {fx.Y0!r}::double) / {-fx.POP_STEP!r}::double - 0.5::double as u from range((select nrows from size)) t(r)),
bx as (select dst, floor(u)::int as src, 1 - (u - floor(u)) as w from bx0 union all select dst, floor(u)::int + 1, u - floor(u) from bx0),
byy as (select dst, floor(u)::int as src, 1 - (u - floor(u)) as w from by0 union all select dst, floor(u)::int + 1, u - floor(u) from by0),
dm as (select c.row, c.col, sum(bx.w * byy.w * density) / nullif(sum(bx.w * byy.w), 0) as density
  from cells c join bx on bx.dst = c.col join byy on byy.dst = c.row join pd on pd.pcol = bx.src and pd.prow = byy.src group by 1, 2),
dens as (select c.row, c.col, greatest(coalesce(dm.density, 0), 0)::float as density from cells c left join dm on dm.row = c.row and dm.col = c.col)"""
