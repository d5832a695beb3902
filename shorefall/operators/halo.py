"""Window operators in tiles: each tile gets a rim of cells from its neighbours, so only rims are shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

TILE = 512


def _tile_of(row, col, tile: int):
    return F.shiftleft(F.floor(row / tile), 32).bitwiseOR(F.floor(col / tile).bitwiseAND(F.lit((1 << 32) - 1)))


def window(cells: DataFrame, bands: dict[str, object], made: Callable[..., np.ndarray], kind: str, reach: int = 1, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """(row, col, value) of the cells, where value is what a window of ``reach`` cells around makes of the bands.

    bands: columns, and the value of cells that have no row. made: takes the bands as arrays with a rim of ``reach`` cells and gives
    the values inside it. Rows are one for each cell, numbered from 0. Cells are shuffled once, into buckets by tile.
    """
    if reach > tile:
        raise ValueError("a window must not reach beyond the next tile")
    scratch = scratch or Scratch(cells.sparkSession)
    names = list(bands)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, col = F.col("row").cast("int"), F.col("col").cast("int")
    dealt = scratch.save_by(cells.select(_tile_of(row, col, tile).alias("tile"), row.alias("row"), col.alias("col"), *names), "tile", parts)
    near = lambda c: (F.col(c) % tile < reach) | (F.col(c) % tile >= tile - reach)
    to = F.array_distinct(F.array(*[_tile_of(F.col("row") + a, F.col("col") + b, tile) for a in (-reach, 0, reach) for b in (-reach, 0, reach)]))
    rim = dealt.where(near("row") | near("col")).select("tile", F.explode(to).alias("to"), "row", "col", *names).where("to <> tile")
    rim = rim.drop("tile").withColumnRenamed("to", "tile")

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"row": own.column("row"), "col": own.column("col"), "value": pa.array([], target)})
        r, c = own.column("row").to_numpy(), own.column("col").to_numpy()
        row0, col0 = r.min() // tile * tile, c.min() // tile * tile
        shape = (tile + 2 * reach, tile + 2 * reach)
        dense = {}
        for n, empty in bands.items():
            values = [t.column(n).to_numpy() for t in (own, other)]
            dense[n] = np.full(shape, empty, values[0].dtype)
            for t, v in zip((own, other), values):
                dense[n][t.column("row").to_numpy() - row0 + reach, t.column("col").to_numpy() - col0 + reach] = v
        out = made(**dense)[r - row0, c - col0]
        return pa.table({"row": own.column("row"), "col": own.column("col"), "value": pa.array(out, target)})

    target = {"boolean": pa.bool_(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64()}[kind]
    return dealt.groupBy("tile").cogroup(rim.groupBy("tile")).applyInArrow(run, f"row int, col int, value {kind}")
