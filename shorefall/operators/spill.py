"""Connection levels: the lowest water at which each cell of land is joined to the sea.

A path to the sea is as high as its highest land; a cell's level is the height of its lowest path. One set of levels for
a surface answers every water level, so tables with many scenarios cost one run for each surface, not one for each flood.

Each tile is reduced to a spill graph over its border cells: every other cell drains to the border cell that it
reaches by the lowest pass, and of the passes between their basins a spanning forest is kept. Graphs of neighbouring
tiles are tied along their border, levels of border cells come from a bottleneck forest of the whole graph (Borůvka
rounds as joins; a graph of a checked small size is solved in one task for each surface), and a second pass over the tiles
carries them to the cells inside. What a task holds is a tile, or a graph of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from ..grid import GridSpec
from ..scratch import Scratch
from ..sources.store import TILE
from .flood import Case, _Tile, deal
from .runs import runs_table

#: A node is field << 48 | row * columns + col; this one is the open sea, the largest of its field.
SEA = (1 << 48) - 1
#: Edges of all fields that are solved in one task for each field; more are solved in rounds of joins.
SMALL = 1_000_000
#: Kinds of a border row beside the number of an edge's other end.
BORDER = -1


@dataclass(frozen=True)
class Field:
    """Heights of a surface (a column of the cells), with four or eight neighbours."""

    surface: str
    neighbours: int = 8


def drain(fixed: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes drain to fixed nodes by paths whose highest edge is lowest.

    Edges a-b must be sorted by weight; their order breaks ties. In each round every component without a fixed
    node joins another by its least edge. The highest edge on a node's best way out is the largest of the edges that
    its components took. Returns each node's fixed node (-1: none can be reached) and that largest edge (inf), the
    edges that were taken, and those that lead from one fixed node's component to another's.
    """
    n, steps, taken, place = len(fixed), [], [], np.arange(len(a))
    still, whole = fixed, np.arange(n)
    while True:
        k, m = len(still), len(a)
        first, other, back = np.full(k, m), np.full(k, m), np.arange(m - 1, -1, -1)
        first[a[::-1]] = back  # of equal places the last one written stays, so the least edge
        other[b[::-1]] = back
        first = np.minimum(first, other)
        own = np.flatnonzero((first < m) & ~still)
        if not len(own):
            break
        to, edge = np.arange(k), first[own]
        to[own] = a[edge] + b[edge] - own
        mutual = own[(to[to[own]] == own) & (own < to[own])]
        to[mutual] = mutual
        while True:
            then = to[to]
            if (then == to).all():
                break
            to = then
        heads = np.flatnonzero(to == np.arange(k))
        number = np.empty(k, np.int64)
        number[heads] = np.arange(len(heads))
        parent = number[to]
        up = np.full(k, -np.inf, w.dtype)
        up[own] = w[place[edge]]
        taken.append(np.unique(place[edge]))
        steps.append((parent, up))
        kept = np.zeros(len(heads), bool)
        kept[parent[still]] = True
        still, whole = kept, parent[whole]
        a, b = parent[a], parent[b]
        live = a != b
        a, b, place = a[live], b[live], place[live]
    owner = np.full(len(still), -1)
    owner[whole[fixed]] = np.flatnonzero(fixed)
    level = np.where(still, np.array(-np.inf, w.dtype), np.array(np.inf, w.dtype))
    for parent, up in reversed(steps):
        level = np.maximum(up, level[parent])
    return owner[whole], level, np.concatenate(taken) if taken else np.zeros(0, np.int64), place


def _edges(height: np.ndarray, diagonal: bool, more: np.ndarray, at: np.ndarray):
    """(order, rank, a, b, w): edges between cells in the order of their heights; ``more`` heights are tied to the cells ``at``.

    Nodes are numbered by height, and an edge is as high as its higher end, so pairs of numbers sort the edges.
    """
    flat = np.concatenate([height.ravel(), more])
    order = np.argsort(flat, kind="stable")
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.arange(len(flat))
    open_ = int(np.searchsorted(flat[order], np.inf))  # blocked cells come last
    r = rank[: height.size].reshape(height.shape)
    pairs = [(r[:, :-1], r[:, 1:]), (r[:-1], r[1:])]
    if diagonal:
        pairs += [(r[:-1, :-1], r[1:, 1:]), (r[:-1, 1:], r[1:, :-1])]
    a = np.concatenate([x.ravel() for x, _ in pairs] + [rank[height.size :]])
    b = np.concatenate([y.ravel() for _, y in pairs] + [r.ravel()[at]])
    high, low = np.maximum(a, b), np.minimum(a, b)
    key = np.sort((high << 32 | low)[high < open_])
    a, b = key >> 32, key & 0xFFFFFFFF
    return order, rank, a, b, flat[order][a]


def spill_graph(height: np.ndarray, ends: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) over the cells ``ends`` (flat places): a forest with their lowest passes inside the grid; inf blocks."""
    order, rank, a, b, w = _edges(height, diagonal, np.zeros(0, height.dtype), ends[:0])
    fixed = np.zeros(len(order), bool)
    fixed[rank[ends]] = True
    basin, _, _, rest = drain(fixed, a, b, w)
    # between basins a pass costs what its edge costs: the ways down on both sides are lower
    nodes, (a, b) = np.flatnonzero(fixed), np.searchsorted(np.flatnonzero(fixed), (basin[a[rest]], basin[b[rest]]))
    _, _, taken, _ = drain(np.zeros(len(nodes), bool), a, b, w[rest])
    return order[nodes[a[taken]]], order[nodes[b[taken]]], w[rest][taken]


def levels_inside(height: np.ndarray, at: np.ndarray, known: np.ndarray, diagonal: bool) -> np.ndarray:
    """Levels of all cells from those known at some; inf where none is reached."""
    if not len(at):
        return np.full(height.shape, np.inf, height.dtype)
    order, rank, a, b, w = _edges(height, diagonal, known.astype(height.dtype), at)
    fixed = np.zeros(len(order), bool)
    fixed[rank[height.size :]] = True
    _, level, _, _ = drain(fixed, a, b, w)
    return level[rank[: height.size]].reshape(height.shape)


def _heights(t: _Tile, field: Field, most: float) -> np.ndarray:
    """The sea is below everything; cells without data, and land above ``most``, block."""
    h = t.dense(field.surface, np.float32("nan"))
    with np.errstate(invalid="ignore"):
        h = np.where(t.land & t.valid & (h <= np.float32(most)), h, np.float32("inf"))
    return np.where(~t.land & t.valid, np.float32("-inf"), h)


def _check(grid: GridSpec, fields: list) -> None:
    if grid.nrows * grid.ncols >= SEA or len(fields) >= 1 << 15:
        raise ValueError("numbers of cells must stay below 2^48 - 1 and surfaces below 32768")


def border_levels(edges: DataFrame, scratch: Scratch, n_fields: int, small: int = SMALL) -> DataFrame:
    """(node, level) of the nodes that reach the sea, by the path whose highest edge is lowest.

    edges: a, b, w; repeated edges do not matter. Up to ``small`` edges are solved in one task for each field.
    """
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b"))
    if edges.count() <= small:
        return edges.withColumn("field", F.shiftright("a", 48)).groupBy("field").applyInArrow(_solved, "node long, level float")
    return _rounds(edges, scratch, n_fields)


def _solved(table: pa.Table) -> pa.Table:
    a, b, w = (table.column(c).to_numpy() for c in "abw")
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(w, kind="stable")
    _, level, _, _ = drain(nodes & SEA == SEA, ends[: len(a)][order], ends[len(a) :][order], w[order])
    found = (level < np.inf) & (nodes & SEA != SEA)
    return pa.table({"node": nodes[found], "level": level[found]})


def _rounds(edges: DataFrame, scratch: Scratch, n_fields: int) -> DataFrame:
    """Borůvka rounds: every component but the sea's takes its least edge, and the components that this ties become nodes."""
    is_sea = lambda c: F.col(c).bitwiseAND(F.lit(SEA)) == SEA
    least = lambda df: df.groupBy("a", "b").agg(F.min("w").alias("w"))
    live, steps = scratch.save(least(edges)), []
    while not live.isEmpty():
        both = live.union(live.select("b", "a", "w")).where(~is_sea("a"))
        edge = F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("b").alias("to"))
        pick = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min(edge).alias("e")).select("node", "e.to", F.col("e.w").alias("up")))
        classes = connected_components(pick, scratch, "node", "to")
        names = classes.groupBy("component").agg(F.max("node").alias("name"))  # the sea is the largest
        named = scratch.save(classes.join(names, "component").select("node", "name"))
        steps.append(scratch.save(pick.select("node", "up").join(named, "node")))
        ends = [named.select(F.col("node").alias(c), F.col("name").alias(f"n{c}")) for c in "ab"]
        moved = live.join(ends[0], "a").join(ends[1], "b", "left").withColumn("nb", F.coalesce("nb", "b"))  # only the sea may have no name yet
        moved = moved.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "w")
        done, live = live, scratch.save(least(moved))
        scratch.drop(done, pick, named)
    seas = edges.sparkSession.createDataFrame([(k << 48 | SEA, float("-inf")) for k in range(n_fields)], "node long, level float")
    level = seas
    for step in reversed(steps):
        above = level.select(F.col("node").alias("name"), F.col("level").alias("high"))
        level = scratch.save(step.join(above, "name").select("node", F.greatest("up", "high").alias("level"))).union(seas)
    return level.where(~is_sea("node"))


def _wet_border(dealt: DataFrame, grid: GridSpec, fields: list[Field], most: list[float], scratch: Scratch, tile: int, small: int) -> DataFrame:
    """(tile, node, level) of border cells that reach the sea."""
    _check(grid, fields)
    ncols = grid.ncols

    def outline(table: pa.Table) -> pa.Table:
        """Border cells with their heights, ties to the open sea, and the spill graph, for each field."""
        t = _Tile(table, tile)
        r, c = np.indices(t.shape)
        r, c = r + t.row0, c + t.col0
        rim = (r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1)
        sea = ((r == 0) | (r == grid.nrows - 1) | (c == 0) | (c == ncols - 1)) & t.valid & ~t.land
        cell = (r * ncols + c).ravel()
        out = []
        for k, field in enumerate(fields):
            h, base = _heights(t, field, most[k]), k << 48
            flat = h.ravel()
            ends = np.flatnonzero(((rim | sea) & (h < np.inf)).ravel())
            a, b, w = spill_graph(h, ends, field.neighbours == 8)
            seeds = np.flatnonzero(sea.ravel())
            edge = ends[rim.ravel()[ends]]
            out.append([base + cell[a], base + cell[b], w])
            out.append([base + cell[seeds], np.full(len(seeds), base + SEA), flat[seeds]])
            out.append([base + cell[edge], np.full(len(edge), BORDER), flat[edge]])
        return pa.table([pa.array(np.concatenate(x), kd) for x, kd in zip(zip(*out), (pa.int64(), pa.int64(), pa.float32()))], ["a", "b", "w"])

    mark = scratch.n
    found = scratch.save(dealt.groupBy("tile").applyInArrow(outline, "a long, b long, w float"))
    place = F.col("a").bitwiseAND(F.lit(SEA))
    row, col = F.floor(place / F.lit(ncols)), place % ncols
    border = found.where(F.col("b") == BORDER).select("a", "w", row.alias("row"), col.alias("col"))
    ways = [(0, 1), (1, 0), (1, -1), (1, 1)]  # of two neighbours one is above or left
    way = F.explode(F.array(*[F.struct(F.lit(x).alias("r"), F.lit(y).alias("c")) for x, y in ways])).alias("way")
    eight = F.array(*[F.lit(f.neighbours == 8) for f in fields])[F.shiftright("a", 48).cast("int")]
    asked = border.select("a", "w", "row", "col", way).where(eight | (F.col("way.r") * F.col("way.c") == 0))
    to_row, to_col = F.col("row") + F.col("way.r"), F.col("col") + F.col("way.c")
    leaves = (F.floor(F.col("row") / tile) != F.floor(to_row / tile)) | (F.floor(F.col("col") / tile) != F.floor(to_col / tile))
    asked = asked.where(leaves & to_col.between(0, ncols - 1)).select("a", F.col("w").alias("wa"), (F.col("a") + F.col("way.r") * F.lit(ncols).cast("long") + F.col("way.c")).alias("b"))
    across = asked.join(border.select(F.col("a").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", F.greatest("wa", "wb").alias("w"))
    level = border_levels(found.where(F.col("b") != BORDER).union(across), scratch, len(fields), small)
    row, col = F.floor(F.col("node").bitwiseAND(F.lit(SEA)) / F.lit(ncols)), F.col("node").bitwiseAND(F.lit(SEA)) % ncols
    number = F.floor(row / tile) * (-(-ncols // tile)) + F.floor(col / tile)
    wet = scratch.save(level.select(number.cast("long").alias("tile"), "node", "level"))
    scratch.drop_since(mark, wet)
    return wet


def _levels(t: _Tile, nodes: pa.Table, grid: GridSpec, fields: list[Field], most: list[float]):
    """Levels of the tile's cells, field by field."""
    node, known = nodes.column("node").to_numpy(), nodes.column("level").to_numpy()
    order = np.argsort(node)
    node, known = node[order], known[order]
    for k, field in enumerate(fields):
        own = slice(*np.searchsorted(node, (k << 48, (k + 1) << 48)))
        place = node[own] & SEA
        at = (place // grid.ncols - t.row0) * t.shape[1] + place % grid.ncols - t.col0
        yield levels_inside(_heights(t, field, most[k]), at, known[own], field.neighbours == 8)


def _run(cells: DataFrame, grid: GridSpec, surfaces: dict[str, Column], fields: list[Field], most: list[float], scratch: Scratch | None, tile: int, carry, small: int, stored: bool, made, schema: str):
    """What ``made`` gives of each tile and the levels of its cells, an array for each field; of tiles that nothing reaches it gets None."""
    scratch = scratch or Scratch(cells.sparkSession)
    place = {n: f"__surface{i}" for i, n in enumerate(surfaces)}
    own = [Field(place[f.surface], f.neighbours) for f in fields]
    dealt = deal(cells, grid, tile, {place[n]: s for n, s in surfaces.items()}, carry, scratch, stored)
    wet = _wet_border(dealt, grid, own, most, scratch, tile, small)

    def inside(table: pa.Table, nodes: pa.Table) -> pa.Table:
        if not table.num_rows or not nodes.num_rows:
            return made(None, table, None)
        t = _Tile(table, tile)
        return made(t, table, [np.where(t.land, level, np.float32("inf")) for level in _levels(t, nodes, grid, own, most)])

    return dealt.groupBy("tile").cogroup(wet.groupBy("tile")).applyInArrow(inside, schema)


def _cells_made(cells: DataFrame, carry, kind: str, n: int, made):
    """(schema, function for ``_run``): a row for each cell that some field reaches, with what is made of its levels."""
    kept = [f for f in cells.schema.fields if f.name in carry]
    schema = "row int, col int, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + kind
    names = ["row", "col", *[f.name for f in kept]]

    def rows(t, table, levels):
        found = np.stack([level[t.at] for level in levels], axis=1) if t else np.zeros((0, n), np.float32)
        some = np.flatnonzero((found < np.inf).any(axis=1))
        picked = table.take(pa.array(some))
        return pa.table([*(picked.column(c) for c in names), made(found[some])], [*names, kind.split()[0]])

    return rows, schema


def connection_levels(
    cells: DataFrame, grid: GridSpec, surfaces: dict[str, Column], fields: list[Field], scratch: Scratch | None = None,
    tile: int = TILE, carry: tuple[str, ...] = (), small: int = SMALL, stored: bool = False,
) -> DataFrame:
    """(row, col, *carry, levels): for each field the lowest water, as a 32-bit float, that joins the cell to the sea.

    Cells and rules are those of ``connected_flood``. A field that never reaches the cell is null; land that no field reaches, and
    the sea, have no row.
    """

    def made(found):
        v = found.ravel()
        return pa.FixedSizeListArray.from_arrays(pa.array(v, mask=v == np.inf), len(fields)).cast(pa.list_(pa.float32()))

    rows, schema = _cells_made(cells, carry, "levels array<float>", len(fields), made)
    return _run(cells, grid, surfaces, fields, [float("inf")] * len(fields), scratch, tile, carry, small, stored, rows, schema)


def _asked(cases: list[Case]) -> tuple[list[Field], list[int], np.ndarray, list[float]]:
    """Fields of the cases, each case's field and water, and each field's highest water."""
    fields = list(dict.fromkeys(Field(c.surface, c.neighbours) for c in cases))
    at = [fields.index(Field(c.surface, c.neighbours)) for c in cases]
    water = np.array([c.water for c in cases], np.float32)
    return fields, at, water, [max(float(w) for w, a in zip(water, at) if a == k) for k in range(len(fields))]


def flood_by_levels(
    cells: DataFrame, grid: GridSpec, surfaces: dict[str, Column], cases: list[Case], scratch: Scratch | None = None,
    tile: int = TILE, carry: tuple[str, ...] = (), small: int = SMALL, stored: bool = False,
) -> DataFrame:
    """The rows of ``connected_flood``, from one set of levels for each surface and kind of neighbours."""
    fields, at, water, most = _asked(cases)

    def made(found):
        row, which = np.nonzero(found[:, at] <= water)
        ends = np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32)))

    rows, schema = _cells_made(cells, carry, "hits array<int>", len(fields), made)
    return _run(cells, grid, surfaces, fields, most, scratch, tile, carry, small, stored, rows, schema).where("size(hits) > 0")


def flood_runs(
    cells: DataFrame, grid: GridSpec, surfaces: dict[str, Column], cases: list[Case], less: list[tuple[int, int]] = (), within: str | None = None,
    scratch: Scratch | None = None, tile: int = TILE, small: int = SMALL, stored: bool = False,
) -> DataFrame:
    """(mask, row, start, stop): floods as runs of cells, cut at tile borders, so that no cell leaves its tile.

    Mask k is case k; mask len(cases) + i holds what case a of the pair ``less[i]`` = (a, b) floods and case b does not. within: a boolean
    column that all masks are limited to.
    """
    fields, at, water, most = _asked(cases)

    def masks(t, levels):
        inside = t.dense(within, False) if within else np.ones(t.shape, bool)
        flood = lambda k: (levels[at[k]] <= water[k]) & inside
        for k in range(len(cases)):
            yield k, flood(k)
        for i, (a, b) in enumerate(less):
            yield len(cases) + i, flood(a) & ~flood(b)

    def rows(t, table, levels):
        return runs_table(masks(t, levels) if t else (), t.row0 if t else 0, t.col0 if t else 0)

    carry = (within,) if within else ()
    return _run(cells, grid, surfaces, fields, most, scratch, tile, carry, small, stored, rows, "mask int, row int, start int, stop int")


def same_masks(cells: DataFrame, surfaces: dict[str, Column], pairs: list[tuple[tuple[str, float], tuple[str, float]]]) -> list[bool]:
    """Whether two (surface, water) have the same low land; one scan for all pairs, and a number for each comes back."""
    kinds = {n: f"__surface{i}" for i, n in enumerate(surfaces)}
    data = cells.where("land and dem is not null").select(*[s.cast("float").alias(kinds[n]) for n, s in surfaces.items()])

    def count(batches):
        differ = np.zeros(len(pairs), np.int64)
        for batch in batches:
            low = {}
            for i, sides in enumerate(pairs):
                for name, water in sides:
                    if (name, water) not in low:
                        with np.errstate(invalid="ignore"):
                            low[name, water] = batch.column(kinds[name]).to_numpy(zero_copy_only=False) <= np.float32(water)
                differ[i] += int((low[sides[0]] != low[sides[1]]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs)).astype(np.int32)), pa.array(differ)], ["i", "n"])

    found = dict(data.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect())
    return [not found.get(i) for i in range(len(pairs))]
