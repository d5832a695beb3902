"""Low land connected to the ocean, tile by tile.

Cells are shuffled to tiles once, into a table in buckets by tile that both passes read; all cases of a call are handled
inside the tile, so cells are never multiplied by cases before a shuffle. In a tile, runs of passable cells are labelled with NumPy; only tile-border cells and
component ids leave it. Components that touch across borders are tied by an equi-join of border cells, and
components of the whole grid come from the contraction in ``graph``, with one node a case for the open sea. A
second pass over the tiles keeps the low land of components that reach the sea. Interior cells never meet a
graph, and what a task holds is one tile.
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
from ..sources.store import TILE, tile_number
from .halo import window

#: A node is case << 48 | tile << 24 | label; this one is the open sea.
SEA = (1 << 48) - 1


@dataclass(frozen=True)
class Case:
    """Land of ``surface`` (a column of the cells) at or below ``water`` is low, compared in 32-bit floats."""

    surface: str
    water: float
    neighbours: int = 8


def label_runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, start, end) of the mask's horizontal runs, as flat places of the mask padded by one column; equal labels are connected."""
    rows, cols = mask.shape
    padded = np.zeros((rows, cols + 1), np.int8)
    padded[:, :cols] = mask
    flat = np.concatenate([[0], padded.ravel(), [0]])
    step = np.diff(flat)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # [start, end)
    reach, width = int(diagonal), cols + 1
    low = np.searchsorted(end, start + width - reach, "right")
    high = np.searchsorted(start, end + width + reach, "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    same = (start[b] // width) == (start[a] // width) + 1
    a, b = a[same], b[same]
    label = np.arange(len(start))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label, start, end
        label = new


def label_cells(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Labels of the mask's cells, -1 elsewhere."""
    label, start, end = label_runs(mask, diagonal)
    rows, cols = mask.shape
    out = np.full(rows * (cols + 1), -1, np.int64)
    out[np.repeat(start, end - start) + np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start)] = np.repeat(label, end - start)
    return out.reshape(rows, cols + 1)[:, :cols]


class _Tile:
    """Dense bands of one tile."""

    def __init__(self, table: pa.Table, tile: int):
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        self.row0, self.col0 = int(row.min()) // tile * tile, int(col.min()) // tile * tile
        self.at = (row - self.row0, col - self.col0)
        self.shape = (int(self.at[0].max()) + 1, int(self.at[1].max()) + 1)
        self.table = table
        self.land, self.valid = self.dense("__land", False), self.dense("__valid", False)

    def dense(self, name: str, empty) -> np.ndarray:
        values = self.table.column(name).to_numpy()
        out = np.full(self.shape, empty, values.dtype)
        out[self.at] = values
        return out

    def masks(self, case: Case) -> tuple[np.ndarray, np.ndarray]:
        """(passable, low land); invalid cells are neither land nor ocean, and block."""
        with np.errstate(invalid="ignore"):
            low = self.land & self.valid & (self.dense(case.surface, np.float32("nan")) <= np.float32(case.water))
        return (~self.land & self.valid) | low, low


def tile_parts(cells: DataFrame, grid: GridSpec, tile: int) -> int:
    """Buckets for a table of tiles: as many as a shuffle has parts, and no more than tiles."""
    return max(1, min(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grid.nrows // tile) * -(-grid.ncols // tile)))


def deal(cells: DataFrame, grid: GridSpec, tile: int, bands: dict[str, Column], carry: tuple[str, ...], scratch: Scratch, stored: bool) -> DataFrame:
    """Cells with the number of their tile, and bands as 32-bit floats, in buckets by tile."""
    out = cells.select(
        F.col("tile") if stored else tile_number(grid, tile).alias("tile"), F.col("row").cast("int"), F.col("col").cast("int"),
        F.coalesce(F.col("land"), F.lit(False)).alias("__land"), F.col("dem").isNotNull().alias("__valid"), *carry, *[s.cast("float").alias(n) for n, s in bands.items()],
    )
    return out if stored else scratch.save_by(out, "tile", tile_parts(cells, grid, tile))


def connected_flood(
    cells: DataFrame, grid: GridSpec, surfaces: dict[str, Column], cases: list[Case], scratch: Scratch | None = None,
    tile: int = TILE, carry: tuple[str, ...] = (), stored: bool = False,
) -> DataFrame:
    """(row, col, *carry, hits): low land connected to the sea; hits lists the indices of the cases that flood the cell.

    cells: row, col, dem (null: no data), land (boolean), one row a cell. Seeds are valid cells off land on the
    outer border of the grid; the sea conducts at any elevation and is not part of the result. Cells flooded in
    no case have no row. A grid without seeds, and an empty table, give no rows.
    """
    scratch = scratch or Scratch(cells.sparkSession)
    if -(-tile // 2) * tile >= 1 << 24 or -(-grid.nrows // tile) * -(-grid.ncols // tile) > 1 << 24 or len(cases) >= 1 << 15:
        raise ValueError("a tile has up to 2^24 runs, a grid up to 2^24 tiles, and a call up to 32767 cases")
    place = {n: f"__surface{i}" for i, n in enumerate(surfaces)}
    cases = [Case(place[c.surface], c.water, c.neighbours) for c in cases]
    dealt = deal(cells, grid, tile, {place[n]: s for n, s in surfaces.items()}, carry, scratch, stored)

    def outline(table: pa.Table) -> pa.Table:
        """Border cells of each case's components, and their ties to the open sea."""
        t = _Tile(table, tile)
        rows, cols = t.shape
        out = []
        r, c = np.indices(t.shape)
        r, c = r + t.row0, c + t.col0
        rim = (r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1)
        outer = (r == 0) | (r == grid.nrows - 1) | (c == 0) | (c == grid.ncols - 1)
        base = int(table.column("tile")[0].as_py()) << 24
        for k, case in enumerate(cases):
            passable, _ = t.masks(case)
            label = label_cells(passable, case.neighbours == 8)
            node = (k << 48 | base) + label
            edge = passable & rim
            n = int(edge.sum())
            out.append([np.full(n, k), r[edge], c[edge], node[edge]])
            sea = np.unique(node[passable & outer & ~t.land])
            out.append([np.full(len(sea), k), np.full(len(sea), -1), np.full(len(sea), -1), sea])
        whole = [np.concatenate(x) for x in zip(*out)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array(x, kd) for x, kd in zip(whole, kinds)], ["case", "row", "col", "node"])

    mark = scratch.n
    border = scratch.save(dealt.groupBy("tile").applyInArrow(outline, "case int, row int, col int, node long"))
    inner = border.where("row >= 0")
    # of each pair of neighbours one is above or left; only those in another tile are asked for
    ways = [(0, 1), (1, 0), (1, -1), (1, 1)]
    eight = F.array(*[F.lit(c.neighbours == 8) for c in cases])[F.col("case")] if cases else F.lit(True)
    way = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ways])).alias("way")
    asked = inner.select("case", "row", "col", "node", way).where(eight | (F.col("way.r") * F.col("way.c") == 0))
    to_row, to_col = F.col("row") + F.col("way.r"), F.col("col") + F.col("way.c")
    leaves = (F.floor(F.col("row") / tile) != F.floor(to_row / tile)) | (F.floor(F.col("col") / tile) != F.floor(to_col / tile))
    asked = asked.where(leaves).select("case", to_row.alias("row"), to_col.alias("col"), F.col("node").alias("src"))
    touching = asked.join(inner.withColumnRenamed("node", "dst"), ["case", "row", "col"]).select("src", "dst").distinct()
    sea = F.shiftleft(F.col("case").cast("long"), 48).bitwiseOR(F.lit(SEA))
    seeds = border.where("row < 0").select(F.col("node").alias("src"), sea.alias("dst"))
    classes = connected_components(touching.union(seeds), scratch)
    seas = classes.where(F.col("node").bitwiseAND(F.lit(SEA)) == SEA).select("component")  # at most one row a case
    reached = classes.join(F.broadcast(seas), "component", "left_semi").where(F.col("node").bitwiseAND(F.lit(SEA)) != SEA)
    wet = scratch.save(reached.select(F.shiftright(F.col("node"), 24).bitwiseAND(F.lit((1 << 24) - 1)).alias("tile"), "node"))
    scratch.drop_since(mark, wet)

    kept = [f for f in cells.schema.fields if f.name in carry]
    schema = "row int, col int, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "hits array<int>"

    def flooded(table: pa.Table, nodes: pa.Table) -> pa.Table:
        names = ["row", "col", *[f.name for f in kept]]
        if not table.num_rows or not nodes.num_rows:
            return pa.table({**{n: table.column(n).slice(0, 0) for n in names}, "hits": pa.array([], pa.list_(pa.int32()))})
        t = _Tile(table, tile)
        node = np.sort(nodes.column("node").to_numpy())
        hit = np.zeros((table.num_rows, len(cases)), bool)
        for k, case in enumerate(cases):
            own = node[np.searchsorted(node, k << 48) : np.searchsorted(node, (k + 1) << 48)] & ((1 << 24) - 1)
            if len(own):
                passable, low = t.masks(case)
                label = label_cells(passable, case.neighbours == 8)
                hit[:, k] = (low & np.isin(label, own))[t.at]
        some = np.flatnonzero(hit.any(axis=1))
        at, which = np.nonzero(hit[some])
        ends = np.searchsorted(at, np.arange(len(some) + 1)).astype(np.int32)
        picked = table.take(pa.array(some))
        return pa.table([*(picked.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32)))], [*names, "hits"])

    return dealt.groupBy("tile").cogroup(wet.groupBy("tile")).applyInArrow(flooded, schema)


def hit_cells(flood: DataFrame, names: list[str]) -> DataFrame:
    """(case_id, row, col): one row for each case that floods a cell."""
    name = F.array(*[F.lit(n) for n in names])
    return flood.select(F.explode("hits").alias("k"), "row", "col").select(name[F.col("k")].alias("case_id"), "row", "col")


def paired_masks(flood: DataFrame, baseline: int, adjusted: int, common: str = "common") -> DataFrame:
    """(row, col, baseline, adjusted, added): flooded cells of the common domain under a pair of cases."""
    b, a = F.array_contains("hits", baseline), F.array_contains("hits", adjusted)
    return flood.where(F.col(common) & (b | a)).select("row", "col", b.alias("baseline"), a.alias("adjusted"), (a & ~b).alias("added"))


def edge_cells(mask: DataFrame, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """(row, col) of true cells (the rows of mask) with a neighbour, of eight, that is not true or lies off the grid."""

    def edge(there):
        rows, cols = there.shape
        whole = np.ones((rows - 2, cols - 2), bool)
        for a in range(3):
            for b in range(3):
                whole &= there[a : rows - 2 + a, b : cols - 2 + b]
        return ~whole

    cells = mask.select("row", "col", F.lit(True).alias("there"))
    return window(cells, {"there": False}, edge, "boolean", tile=tile, scratch=scratch).where("value").select("row", "col")
