"""Connection levels against a plain priority queue, and floods by levels against the direct path."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.grid import GridSpec
from shorefall.operators import spill
from shorefall.operators.flood import Case, connected_flood
from shorefall.operators.spill import Field, connection_levels, drain, flood_by_levels, spill_graph

SCHEMA = "row int, col int, dem float, land boolean, up float, tag string"


def lowest(height, seeds, eight):
    """Levels by a priority queue from the seeds."""
    out = np.full(height.shape, np.inf, np.float32)
    todo = []
    for p in seeds:
        out[p] = height[p]
        todo.append((height[p], p))
    heapq.heapify(todo)
    while todo:
        h, (r, c) = heapq.heappop(todo)
        if h > out[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                q = (r + a, c + b)
                if (a or b) and (eight or not a * b) and 0 <= q[0] < height.shape[0] and 0 <= q[1] < height.shape[1]:
                    to = max(h, height[q])
                    if to < out[q]:
                        out[q] = to
                        heapq.heappush(todo, (to, q))
    return out


def random_cells(rng, n, m, steps):
    rows = [(r, c, None if rng.random() < 0.05 else float(rng.integers(0, steps)) / 3, bool(rng.random() > 0.1), float(rng.integers(0, steps)) / 7 if rng.random() > 0.03 else None, f"{r}") for r in range(n) for c in range(m)]
    return rows


def heights_of(rows, n, m, column):
    h, sea = np.full((n, m), np.inf, np.float32), []
    for r, c, dem, land, up, _ in rows:
        v = dem if column == "dem" else up
        if dem is not None:
            h[r, c] = -np.inf if not land else np.inf if v is None else np.float32(v)
            if not land and (r in (0, n - 1) or c in (0, m - 1)):
                sea.append((r, c))
    return h, sea


@pytest.mark.parametrize("tile, small", [(1, 10**6), (4, 0), (16, 10**6), (16, 0), (64, 10**6), (512, 0)])
def test_levels_against_a_priority_queue(spark, tile, small):
    rng = np.random.default_rng(tile)
    n, m = 21, 37
    rows = random_cells(rng, n, m, 9)
    cells, grid = spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, n, m)
    fields = [Field("dem"), Field("dem", 4), Field("up")]
    got = connection_levels(cells, grid, {"dem": F.col("dem"), "up": F.col("up")}, fields, tile=tile, carry=("tag",), small=small).collect()
    want = {}
    for k, f in enumerate(fields):
        h, sea = heights_of(rows, n, m, f.surface)
        level = lowest(h, sea, f.neighbours == 8)
        for r, c in zip(*np.nonzero((level < np.inf) & (h > -np.inf))):
            want.setdefault((int(r), int(c)), [None] * len(fields))[k] = float(level[r, c])
    assert {(r.row, r.col): r.levels for r in got} == want
    assert all(r.tag == str(r.row) for r in got) and len(got) == len(want)


@pytest.mark.parametrize("tile", [16, 64, 512])
def test_flood_by_levels_is_the_direct_flood(spark, tile):
    rng = np.random.default_rng(5)
    n, m = 40, 70
    rows = random_cells(rng, n, m, 30)
    cells, grid = spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, n, m)
    surfaces = {"dem": F.col("dem"), "up": F.col("up")}
    cases = [Case(s, w, k) for s in surfaces for w in (0.0, 1.0, 2.5, 4.0, 9.9) for k in (4, 8)]
    of = lambda how: sorted(map(tuple, how(cells, grid, surfaces, cases, tile=tile).collect()))
    direct = of(connected_flood)
    assert of(flood_by_levels) == [x for x in direct if x[2]] and direct


def test_both_passes_read_tiles_without_an_exchange(spark):
    rows = random_cells(np.random.default_rng(1), 40, 40, 9)
    cells, grid = spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, 40, 40)
    out = flood_by_levels(cells, grid, {"dem": F.col("dem")}, [Case("dem", 1.0)], tile=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    tiles = plan[plan.index("FlatMapCoGroups") :]
    assert tiles.count("Exchange hashpartitioning(tile") == 1  # the few border cells; the tiles are scanned from their buckets
    assert "Bucketed: true" in tiles or "SelectedBucketsCount" in tiles


def test_empty_and_without_sea(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert connection_levels(empty, GridSpec(0, 1, 0, -1, 1, 1), {"dem": F.col("dem")}, [Field("dem")]).collect() == []
    dry = spark.createDataFrame([(0, 0, 1.0, True, 1.0, "x"), (0, 1, None, False, 1.0, "x")], SCHEMA)
    assert flood_by_levels(dry, GridSpec(0, 1, 0, -1, 1, 2), {"dem": F.col("dem")}, [Case("dem", 5.0)]).collect() == []


def test_float32_border(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, False, 0.0, ""), (0, 1, 0.1, True, 0.0, "")], SCHEMA)
    out = flood_by_levels(cells, GridSpec(0, 1, 0, -1, 1, 2), {"dem": F.col("dem")}, [Case("dem", 0.1)])
    assert [(r.row, r.col, r.hits) for r in out.collect()] == [(0, 1, [0])]


def test_spill_graph_keeps_lowest_passes():
    rng = np.random.default_rng(7)
    for trial in range(30):
        n, m = rng.integers(1, 12, 2)
        h = rng.integers(0, 6, (n, m)).astype(np.float32)
        h[rng.random((n, m)) < 0.2] = np.inf
        rim = np.zeros((n, m), bool)
        rim[[0, -1]] = rim[:, [0, -1]] = True
        ends = np.flatnonzero((rim & (h < np.inf)).ravel())
        diagonal = bool(trial % 2)
        a, b, w = spill_graph(h, ends, diagonal)
        assert len(a) < max(1, len(ends))
        for start in ends[:4]:
            want = lowest(h, [tuple(np.unravel_index(start, h.shape))], diagonal).ravel()[ends]
            nodes = np.searchsorted(ends, np.array([a, b]))
            level = np.full(len(ends), np.inf, np.float32)
            at = int(np.searchsorted(ends, start))
            level[at] = h.ravel()[start]
            for _ in ends:  # the forest by plain relaxation
                for x, y, v in zip(*nodes, w):
                    level[x], level[y] = min(level[x], max(level[y], v)), min(level[y], max(level[x], v))
            assert (level == want).all()


def test_drain_of_a_path_takes_few_rounds():
    n = 1 << 14
    w = np.arange(n - 1, dtype=np.float32)
    owner, level, taken, rest = drain(np.arange(n) == n - 1, np.arange(n - 1), np.arange(1, n), w)
    assert (owner == n - 1).all() and len(taken) == n - 1 and not len(rest)
    assert level[-1] == -np.inf and (level[:-1] == n - 2).all()


def test_numbers_that_do_not_fit_are_refused(spark):
    cells = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        connected_flood(cells, GridSpec(0, 1, 0, -1, 10**9, 10**9), {"dem": F.col("dem")}, [Case("dem", 1.0)])
    with pytest.raises(ValueError):
        connection_levels(cells, GridSpec(0, 1, 0, -1, 10**9, 10**9), {"dem": F.col("dem")}, [Field("dem")])
    assert spill.SEA == 2**48 - 1


def test_scratch_tables_go(spark, tmp_path):
    from shorefall.scratch import Scratch

    rows = random_cells(np.random.default_rng(1), 30, 30, 9)
    cells, grid = spark.createDataFrame(rows, SCHEMA), GridSpec(0, 1, 0, -1, 30, 30)
    for how, small in ((connected_flood, None), (flood_by_levels, 0), (flood_by_levels, 10**6)):
        scratch = Scratch(spark)
        scratch.root = f"file://{tmp_path}/{how.__name__}{small}"
        out = how(cells, grid, {"dem": F.col("dem")}, [Case("dem", 2.0)], scratch=scratch, tile=8, **({} if small is None else {"small": small}))
        assert len(list((tmp_path / f"{how.__name__}{small}").iterdir())) == 2  # the tiles, and what reaches the sea
        assert out.count() > 0
