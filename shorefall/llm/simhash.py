"""SimHash near-duplicates with covering locality-sensitive hashing.

A random map gives each of the 64 bits a nonzero vector phi of r + 1 bits. For each of the 2^(r+1) - 1 nonzero
vectors v, table v keeps the fingerprint bits with phi.v odd. At most r differing bits span at most r
dimensions, so some v is orthogonal to all of them, and that table keeps none of them: every pair within
radius r collides in some table (Pagh, 2016), at about half of the bits a key.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from ..scratch import Scratch
from .text import LOWER, map_slices, raw, unused

RADIUS = 3
#: Rows of one key that are compared at once; a key with more is dealt as pairs of parts of this size.
PART = 1024
#: Rows compared at once inside a task.
ROWS = 4096


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles (repeats count) of a text; 0 for a text without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[k - 1 :])], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null text: no words, so 0."""

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in raw(b.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

        return part

    return map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", make, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed longs; phi goes round all nonzero vectors so that masks weigh alike."""
    n = (1 << (radius + 1)) - 1
    phi = [1 + (i * 7) % n for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if bin(phi[i] & v).count("1") & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _local_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: a forest that joins the rows linked within each key."""
    n = len(fp)
    label, left, right = np.arange(n), [], []
    shift, live = 1, np.arange(n - 1)
    while len(live):
        live = live[live + shift < n]
        live = live[key[live] == key[live + shift]]
        near = live[np.bitwise_count((fp[live] ^ fp[live + shift]).view(np.uint64)) <= radius]
        left.append(near)
        right.append(near + shift)
        shift += 1
    a, b = np.concatenate(left or [label[:0]]), np.concatenate(right or [label[:0]])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(n))
    return fp[tied], fp[label[tied]]


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(src, dst) of distinct fingerprints: edges whose components are those of all pairs within ``radius``.

    Keys held by one fingerprint go first (counts are combined before their shuffle). A key with more than
    PART rows is dealt as pairs of parts, so no task sees more than two parts of it, and all pairs of rows
    still meet.
    """
    masks = covering_masks(radius)
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    keyed = scratch.save(fps.select("fp", keys.alias("t", "key")))  # read twice
    shared = keyed.groupBy("t", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(shared, ["t", "key"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select("t", "key", "fp", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
        .select("t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
        .withColumn("g", F.xxhash64("t", "key", "p", "q"))
        .repartition("g")
        .sortWithinPartitions("g", "key", "p", "q")
        .select("g", "fp")
    )

    def run(batches):
        def flush(g, fp):
            a, b = _local_links(g, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                cut = batch.slice(at, ROWS)
                g = np.concatenate([rest_g, cut.column(0).to_numpy()])
                f = np.concatenate([rest_f, cut.column(1).to_numpy()])
                end = int(np.searchsorted(g, g[-1]))  # the last key may go on in the next rows
                if end:
                    yield flush(g[:end], f[:end])
                rest_g, rest_f = g[end:], f[end:]
        if len(rest_g):
            yield flush(rest_g, rest_f)

    return dealt.mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row, component_id the smallest id reachable over links of ``radius``.

    Equal fingerprints meet in one aggregate, so copies are never paired; only distinct fingerprints are
    compared. Null texts have fingerprint 0. Rows with a null id stay, in the class of their fingerprint;
    a class with null ids alone has a null component. Repeated rows stay. An empty table gives an empty one. Other columns
    take no part; a long text is read whole, as a list of its words.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, id_col, text_col))
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = connected_components(links(fps.select("fp"), scratch, radius), scratch)
    named = fps.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = scratch.save(named.join(least, "component").select("fp", "component_id"))
    scratch.drop_since(0, rows, ids)
    return rows.join(ids, "fp")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` (its columns alone): one of each class, that with the smallest doc_id.

    Of repeated rows with that id one stays (the smallest text, nulls first). Rows with a null doc_id are kept:
    they can't be named as a class's first. An empty table gives an empty one; columns of any name are kept.
    """
    (row,) = unused(docs, "row")
    scratch = Scratch(docs.sparkSession)
    keep = scratch.save(components(docs, radius).where("doc_id = component_id").select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").select(docs.columns)
    twice = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = F.min_by(whole, F.struct(F.col("text").isNotNull(), "text")).alias(row)
    again = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(first).select(f"{row}.*")
    return named.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again).unionByName(docs.where("doc_id is null"))
