"""Exact percentiles (linear interpolation) of any number of values, by radix selection.

The bits of a float, turned so that they order as the values do, are read BITS at a time from the top. A pass counts the values
of every column by their next bits, among those that agree with the bits found so far, and so settles these bits of all places
asked for. Three passes do for 32-bit floats and six for doubles, at any size and however values are spread; a task
holds counters alone, and a pass brings back at most 2^BITS of them for each place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

BITS = 11


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that order as the floats do; both zeros are one, NaN is above all."""
    v = np.where(np.isnan(values), np.array(np.nan, values.dtype), values + 0)
    kind = np.uint32 if values.dtype == np.float32 else np.uint64
    u = v.view(kind)
    top = kind(1) << kind(8 * values.itemsize - 1)
    return np.where(u & top, ~u, u | top)


def from_bits(bits: int, width: int) -> float:
    kind, real = (np.uint32, np.float32) if width == 32 else (np.uint64, np.float64)
    top = 1 << (width - 1)
    return float(np.array([bits ^ top if bits & top else bits ^ ((1 << width) - 1)], kind).view(real)[0])


def _counts(data: DataFrame, width: int, done: int, asked: list[list[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(column, start) -> (next bits, count) in order, of values whose first ``done`` bits are the start."""
    take = min(BITS, width - done)

    def count(batches):
        kind = np.uint32 if width == 32 else np.uint64
        found = {(i, s): np.zeros(1 << take, np.int64) for i, own in enumerate(asked) for s in own}
        for batch in batches:
            for i, own in enumerate(asked):
                u = ordered_bits(batch.column(i).drop_null().to_numpy())
                for s in own:
                    some = u[u >> kind(width - done) == kind(s)] if done else u
                    found[i, s] += np.bincount((some >> kind(width - done - take) & kind((1 << take) - 1)).astype(np.int64), minlength=1 << take)
        rows = [(i, s, b, n[b]) for (i, s), n in found.items() for b in np.flatnonzero(n)]
        kinds = (("i", pa.int32()), ("s", pa.decimal128(20)), ("b", pa.int32()), ("n", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], kd) for k, (_, kd) in enumerate(kinds)], [c for c, _ in kinds])

    out: dict = {}
    counted = data.mapInArrow(count, "i int, s decimal(20), b int, n long").groupBy("i", "s", "b").agg(F.sum("n").alias("n"))
    for r in sorted(counted.collect()):
        out.setdefault((r.i, int(r.s)), []).append((r.b, r.n))
    return out


def exact_percentiles(df: DataFrame, values: list[Column], q: float | list[float]) -> list[float | None]:
    """The q-th percentile (or one of its own) of each column, nulls left out; None for a column without values.

    NaN counts as the largest value. 32-bit floats stay so if all columns are; other numbers are read as doubles. The table is
    scanned once a pass, so save what is costly to compute.
    """
    if not values:
        return []
    qs = q if isinstance(q, list) else [q] * len(values)
    data = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    width = 32 if all(isinstance(f.dataType, FloatType) for f in data.schema.fields) else 64
    data = data.select(*[F.col(c).cast("float" if width == 32 else "double") for c in data.columns])
    counts = _counts(data, width, 0, [[0] for _ in values])
    places: dict[int, list[list[int]]] = {}  # of each column its (start, rank inside it) below and above the place
    for i, p in enumerate(qs):
        if n := sum(k for _, k in counts.get((i, 0), [])):
            places[i] = [[0, math.floor(p * (n - 1))], [0, math.ceil(p * (n - 1))]]
    sizes = {i: sum(k for _, k in counts[i, 0]) for i in places}
    done = 0
    while done < width and places:
        if done:
            counts = _counts(data, width, done, [sorted({s for s, _ in places.get(i, [])}) for i in range(len(values))])
        take = min(BITS, width - done)
        for i, own in places.items():
            for place in own:
                start, rank = place
                for b, k in counts[i, start]:
                    if rank < k:
                        break
                    rank -= k
                place[:] = [start << take | b, rank]
        done += take
    out: list[float | None] = []
    for i, p in enumerate(qs):
        if i not in places:
            out.append(None)
            continue
        (low, _), (high, _) = places[i]
        at = p * (sizes[i] - 1)
        a, b = from_bits(low, width), from_bits(high, width)
        out.append(a if low == high else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out
