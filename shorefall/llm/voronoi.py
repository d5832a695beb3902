"""Exact top-k by inner product: a Voronoi join.

A bounded sample gives pivots and, for each query, a score that its k-th best answer reaches at least. Every
vector, query or not, goes to its nearest pivot's cell; a cell's summary (its radius and largest norm) bounds the
score of any query with any member, so queries ask only for cells that can still hold an answer. Rows are dealt
in chunks of bounded size by their cells, neighbouring cells together, and a query is sent once to each chunk
with a cell that it asks for. Queries are put in blocks of bounded size in the same way, so that the queries of a
block ask for much the same chunks, and a chunk goes only to the blocks that ask for it: a table with fewer
queries than a block holds is sent once. One hot cell (say, one
vector repeated in a third of the rows) is spread, and no task holds more than a chunk and a block. Each pair
(chunk, block) is solved by a matrix product; the final ranking merges at most k rows of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .sample import bounded
from .text import mix

#: Sampled rows, whatever the table's size: all give lower bounds of the answers, the first of them are pivots.
SAMPLE = 2048
#: Pivots at least and at most; between, the root of the number of vectors.
PIVOTS = (64, 1024)
#: Vectors of a chunk and queries of a block at most, fewer where that would be more than BYTES of components.
CHUNK, BLOCK, BYTES = 32_768, 32_768, 32 << 20
#: Scores computed at once inside a task, and queries routed at once.
SCORES, ROUTED = 1 << 21, 512
FARTHEST = 1e150


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, as a double, which holds every such integer exactly.

    Rows take no part if id or vector is null, or a component is null, NaN or infinite. Finite ones whose squares no
    double holds (scaled, FARTHEST or more) are an error that names the row.
    """
    x = F.col(vec_col)
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = lambda v: v.cast("double") * scale
    far = F.exists(x, lambda v: F.abs(scaled(v)) >= FARTHEST)
    message = F.concat(F.lit("vec_id "), F.col(id_col).cast("string"), F.lit(f": a component beyond {FARTHEST:g} / {scale:g}"))
    x = F.when(whole & far, F.raise_error(message).cast(vectors.schema[vec_col].dataType)).otherwise(x)
    ints = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < float(1 << 52), F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("q"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of float64, padded with zeros to dims."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where that is exact, else in int64, else as Python's integers."""
    most = float(a.shape[1]) * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.array([[int(v) for v in row] for row in a], object) @ np.array([[int(v) for v in row] for row in b], object).T


def _best(ids: np.ndarray, xs: np.ndarray, qid: np.ndarray, qs: np.ndarray, least: np.ndarray, k: int):
    """Rows (query, id, score) of each query's k best among xs that reach ``least``; ids are sorted."""
    score = _products(qs, xs)
    row, col = np.nonzero((score >= least[:, None]) & (ids[None, :] != qid[:, None]))
    got = place = score[row, col]
    if got.dtype == object:
        place = np.searchsorted(np.sort(got), got)
    order = np.lexsort((col, -place, row))
    row, col, got = row[order], col[order], got[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], ids[col[keep]], got[keep]


def deal(placed: DataFrame, routed: DataFrame) -> DataFrame:
    """(vec_id, q, chunk, block) of candidates, for those blocks alone of which some query was sent to their chunk."""
    asked = routed.select("block", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.collect_set("block").alias("blocks"))
    return placed.join(asked, "chunk").select("vec_id", "q", "chunk", F.explode("blocks").alias("block"))


def _parts(pivots: np.ndarray, rows: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each cell: its rows go to parts first to first + parts - 1, of ``most`` rows each, about.

    Cells are taken along the direction in which the pivots spread most, so that the cells of a part lie
    together; a cell with more rows than a part holds has parts of its own.
    """
    spread = pivots - pivots.mean(axis=0)
    along = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable") if pivots.size else np.arange(len(pivots))
    first, parts = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    part = held = 0
    for cell in along.tolist():
        n = rows.get(cell, 0)
        if held and held + n > most:
            part, held = part + 1, 0
        first[cell], parts[cell] = part, max(1, -(-n // most))
        held += n
        if held >= most:
            part, held = part + int(parts[cell]), 0
    return first, parts


def chunks_of(asks_for: np.ndarray, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, chunk) pairs, sorted and distinct, of (query asks for cell) and the cells' chunks; memory follows what is asked for."""
    r, c = np.nonzero(asks_for)
    n = parts[c]
    chunk = np.repeat(first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(np.repeat(r, n).astype(np.int64) << 32 | chunk)
    return pairs >> 32, pairs & 0xFFFFFFFF


def route(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, int] | None:
    """(placed, routed, dims); None for a table without vectors.

    placed: vec_id, q, cell, chunk of every vector. routed: query_id, q, least, block and the chunks of all cells
    that can hold one of the query's k best.
    """
    spark = vectors.sparkSession
    ints = quantised(vectors, id_col, vec_col)
    n, dims = ints.agg(F.count("*"), F.max(F.size("q"))).first()
    if dims is None:
        return None
    room = BYTES // (8 * max(1, dims))
    chunk, block = max(1, min(CHUNK, room)), max(1, min(BLOCK, room))
    picked = bounded(ints, SAMPLE, "vec_id", "q").toArrow()
    sample_ids, sample = picked.column(0).to_numpy(), _matrix(picked.column(1), dims)
    order = np.argsort(sample_ids, kind="stable")
    pivots = np.unique(sample[: min(PIVOTS[1], max(PIVOTS[0], math.isqrt(n)))], axis=0)
    sample_ids, sample = sample_ids[order], sample[order]

    def assign(batches):
        half = (pivots**2).sum(axis=1) / 2
        for b in batches:
            x = _matrix(b.column(1), dims)
            cell = np.argmin(half[None, :] - x @ pivots.T, axis=1) if len(x) else np.zeros(0, np.int64)
            far, norm = np.linalg.norm(x - pivots[cell], axis=1), np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(norm)], ["vec_id", "q", "cell", "far", "norm"])

    placed = scratch.save(ints.mapInArrow(assign, "vec_id long, q array<double>, cell int, far double, norm double"))
    # one row a cell, so at most as many as pivots
    asks = F.coalesce(is_query, F.lit(False))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.count_if(asks).alias("asked")).orderBy("cell").toPandas()
    number, reach, norms = cells["cell"].to_numpy(), cells["far"].to_numpy(), cells["norm"].to_numpy()
    first, parts = _parts(pivots, dict(zip(number.tolist(), cells["n"].tolist())), chunk)
    block_first, block_parts = _parts(pivots, dict(zip(number.tolist(), cells["asked"].tolist())), block)
    dealt_as = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in number], "cell int, first int, parts int")
    placed = placed.join(F.broadcast(dealt_as), "cell").withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))).cast("int"))  # rows that repeat an id are spread too

    def bound(batches):
        for b in batches:
            for at in range(0, len(b), ROUTED):
                yield bound_part(b.slice(at, ROUTED))

    def bound_part(b):
        q, qid, home = _matrix(b.column(1), dims), b.column(0).to_numpy(), b.column(2).to_numpy()
        least = np.full(len(q), np.iinfo(np.int64).min)
        row, _, got = _best(sample_ids, sample, qid, q, least, k)
        full = np.bincount(row, minlength=len(q)) == k
        last = np.searchsorted(row, np.arange(len(q)), "right") - 1
        least[full] = [max(-(2**63), min(2**63 - 1, int(v))) for v in got[last[full]]]
        size = np.linalg.norm(q, axis=1)
        most = np.minimum(q @ pivots[number].T + size[:, None] * reach, size[:, None] * norms)
        asks_for = most * (1 + 1e-9) + np.abs(most) * 1e-9 + size[:, None] * norms * 1e-9 + 1e-3 >= least[:, None]
        r, c = chunks_of(asks_for, first[number], parts[number])
        own = block_first[home] + (mix(qid.astype(np.int64).view(np.uint64)) % block_parts[home].astype(np.uint64)).astype(np.int64)
        asked_chunks = pa.ListArray.from_arrays(np.searchsorted(r, np.arange(len(q) + 1)).astype(np.int32), pa.array(c.astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.array(own.astype(np.int32)), asked_chunks], ["query_id", "q", "least", "block", "chunks"])

    asked = placed.where(asks).select("vec_id", "q", "cell").distinct()
    routed = scratch.save(asked.mapInArrow(bound, "query_id long, q array<double>, least long, block int, chunks array<int>"))
    return placed, routed, dims


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    is_query: condition on vec_id. Vectors of unequal length are padded with zeros. Rows that repeat a
    candidate's id each count; rows with the query's own id do not. An empty table gives no rows; other columns
    play no part. A score among the k best that does not fit 64 bits is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    found = route(vectors, is_query, k, id_col, vec_col, scratch)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, routed, dims = found
    sent = routed.withColumn("chunk", F.explode("chunks")).drop("chunks")
    dealt = deal(placed, routed)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "key", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        ids = right.column("vec_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        xs, ids = _matrix(right.column("q"), dims)[by], ids[by]
        qid, qs, least = left.column("query_id").to_numpy(), _matrix(left.column("q"), dims), left.column("least").to_numpy()
        keys, out, step = left.column("key").to_numpy(), [], max(1, SCORES // len(ids))
        for at in range(0, len(qid), step):
            row, vid, got = _best(ids, xs, qid[at : at + step], qs[at : at + step], least[at : at + step], k)
            # Arrow refuses an integer beyond 64 bits
            out.append(pa.table([pa.array(qid[at : at + step][row]), pa.array(keys[at : at + step][row]), pa.array(vid), pa.array(got.tolist(), pa.int64())], names))
        return pa.concat_tables(out)

    key = ["chunk", "block"]
    found = sent.withColumn("key", F.xxhash64("q")).groupBy(key).cogroup(dealt.groupBy(key)).applyInArrow(solve, "query_id long, key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
