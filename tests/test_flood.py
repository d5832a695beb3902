"""Hand grids and random grids for the connected flood, against a plain breadth-first search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.grid import GridSpec
from shorefall.operators.flood import Case, connected_flood, edge_cells, label_cells

SCHEMA = "row int, col int, dem float, land boolean"


def cells_of(spark, text: list[str]):
    """~ ocean, x no data, digits: land at that height."""
    rows = [(r, c, None if ch == "x" else 0.0 if ch == "~" else float(ch), ch not in "~x") for r, line in enumerate(text) for c, ch in enumerate(line)]
    return spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, len(text), len(text[0]))


def search(cells, nrows, ncols, water, eight):
    at = {(r, c): (d, land) for r, c, d, land in cells}
    ok = lambda p: p in at and at[p][0] is not None and (not at[p][1] or np.float32(at[p][0]) <= np.float32(water))
    seen = {p for p, (d, land) in at.items() if d is not None and not land and (p[0] in (0, nrows - 1) or p[1] in (0, ncols - 1))}
    todo = list(seen)
    while todo:
        r, c = todo.pop()
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                p = (r + a, c + b)
                if (a or b) and (eight or not a * b) and p not in seen and ok(p):
                    seen.add(p)
                    todo.append(p)
    return {p for p in seen if at[p][1]}


def flooded(spark, text, water, neighbours=8, tile=512):
    cells, grid = cells_of(spark, text)
    out = connected_flood(cells, grid, {"dem": F.col("dem")}, [Case("dem", water, neighbours)], tile=tile)
    return {(r.row, r.col) for r in out.collect()}


@pytest.mark.parametrize("tile", [2, 512])
@pytest.mark.parametrize("text, water, eight, four", [
    (["~~999", "99999", "99119", "99999"], 1, set(), set()),  # a hollow without a way to the sea
    (["~999", "9199", "9919", "9991"], 1, {(1, 1), (2, 2), (3, 3)}, set()),  # joined by corners only, across tile corners too
    (["~x11", "~x11"], 1, set(), set()),  # no data blocks
    (["9999", "91~9", "9119", "9999"], 1, set(), set()),  # inland water is no seed
    (["~1199", "99919", "99119"], 1, {(0, 1), (0, 2), (1, 3), (2, 2), (2, 3)}, {(0, 1), (0, 2)}),
])
def test_hand_grids(spark, text, water, eight, four, tile):
    assert flooded(spark, text, water, 8, tile) == eight
    assert flooded(spark, text, water, 4, tile) == four


def test_float32_border(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, False), (0, 1, 0.1, True)], SCHEMA)
    out = connected_flood(cells, GridSpec(0, 1, 0, -1, 1, 2), {"dem": F.col("dem")}, [Case("dem", 0.1)])
    assert [(r.row, r.col, r.hits) for r in out.collect()] == [(0, 1, [0])]  # 0.1 as a double is below 0.1 as a float


def test_random_grids_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    n, m = 17, 23
    rows = [(r, c, None if rng.random() < 0.05 else float(rng.integers(0, 5)), bool(rng.random() > 0.12)) for r in range(n) for c in range(m)]
    cells, grid = spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, n, m)
    cases = [Case("dem", 1.0), Case("dem", 2.0), Case("dem", 1.0, 4), Case("up", 2.0, 4)]
    surfaces = {"dem": F.col("dem"), "up": F.col("dem") + F.lit(1.0).cast("float")}
    up = [(r, c, None if d is None else d + 1, land) for r, c, d, land in rows]
    want = [search(rows, n, m, 1, True), search(rows, n, m, 2, True), search(rows, n, m, 1, False), search(up, n, m, 2, False)]
    for tile in (1, 5, 64):
        out = connected_flood(cells, grid, surfaces, cases, tile=tile).collect()
        got = [{(r.row, r.col) for r in out if k in r.hits} for k in range(len(cases))]
        assert got == want
    assert want[2] <= want[0] <= want[1]


def test_empty_table(spark):
    out = connected_flood(spark.createDataFrame([], SCHEMA), GridSpec(0, 1, 0, -1, 1, 1), {"dem": F.col("dem")}, [Case("dem", 1.0)])
    assert out.collect() == []


def test_label_cells_spiral():
    mask = np.array([[c == "#" for c in line] for line in ["#######", "      #", "##### #", "#   # #", "# ### #", "#     #", "#######"]])
    assert len(np.unique(label_cells(mask, False)[mask])) == 1
    assert (label_cells(np.zeros((2, 3), bool), True) == -1).all()


def test_edge_cells(spark):
    mask = spark.createDataFrame([(r, c) for r in range(4) for c in range(5)], "row int, col int")
    got = {(r.row, r.col) for r in edge_cells(mask).collect()}
    assert got == {(r, c) for r in range(4) for c in range(5)} - {(r, c) for r in (1, 2) for c in (1, 2, 3)}
