"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns. Its key is a hash of its depth and of sums over its turns, each turn hashed
with its place, so that keys of all prefixes come from running sums, also of a conversation that holds most rows.
Subtree totals take two steps: nodes are added to their ancestors within a band of BAND depths only, and the
totals of nodes on top of a band, once complete, to the ancestors in the band above. Tops form a trie themselves,
BAND times less deep, and are completed in the same way; so a trie of depth D takes log D rounds to the base BAND, and no
node goes to more than BAND ancestors in a round.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .running import running

BAND = 8
#: Conversations of a hundred share the beginning of the first; it has up to FORK - 1 turns.
FAMILY, FORK = 100, 6
#: Ids that go into one piece of a list.
PIECE = 4096
SUMS = ("s0", "s1", "s2", "s3")
KEY = ("ka", "kb")
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, role, text, cps): turns by place (from 1); role and text are MD5 digests, cps is the text's length in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.md5(role).alias("role"), F.md5(text).alias("text"), F.length(text).cast("long").alias("cps")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    out = running(scratch.save(turns), scratch, ["conv"], order, {"before": F.lit(1).cast("long")})
    return out.select("conv", (F.col("before") + 1).alias("pos"), "role", "text", "cps")


def forked(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, n), turns (conv, pos, role, text, cps)) with the first turns taken from the first of each hundred.

    turns: as ``numbered`` gives them. A conversation takes h = crc32(conv) mod 6 turns from conversation conv - conv mod 100 (all if it has fewer,
    none if it does not exist) and keeps its own behind its first h; one may end up without turns.
    """
    lengths = scratch.save(turns.groupBy("conv").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("conv").cast("string")) % FORK
    want = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("head"))
    want = want.join(lengths.select(F.col("conv").alias("head"), F.col("n").alias("there")), "head", "left")
    want = scratch.save(want.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    first = turns.where(f"pos < {FORK}").withColumnRenamed("conv", "head")
    heads = want.select("conv", "head", "taken").join(first, "head").where("pos <= taken").select("conv", "pos", "role", "text", "cps")
    own = turns.join(want.select("conv", "h", "taken"), "conv").where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text", "cps")
    return want.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), heads.union(own)


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, *sums).alias(k) for seed, k in enumerate(KEY)]


def _prefixes(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, ka, kb, pa, pb, cps, last): a row for each conversation and prefix, the empty one (pos 0) too."""
    halves = [f(F.xxhash64(F.lit(seed), "pos", "role", "text")) for seed in (0, 1) for f in (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)), lambda x: F.shiftrightunsigned(x, 32))]
    hashed = turns.select("conv", "pos", "cps", *[v.alias(f"x{i}") for i, v in enumerate(halves)])
    summed = running(scratch.save(hashed), scratch, ["conv"], [F.col("pos")], {s: F.col(f"x{i}") for i, s in enumerate(SUMS)})
    before, after = [F.col(s) for s in SUMS], [F.col(s) + F.col(f"x{i}") for i, s in enumerate(SUMS)]
    up = [k.alias(n) for k, n in zip(_key(F.col("pos") - 1, before), ("pa", "pb"))]
    rows = summed.select("conv", "pos", *_key(F.col("pos"), after), *up, "cps")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("pos"), *_key(zero, [zero] * len(SUMS)), none.alias("pa"), none.alias("pb"), zero.alias("cps"))
    return scratch.save(rows.union(root).join(convs, "conv").withColumn("last", F.col("pos") == F.col("n")).drop("n"))


def rollup(nodes: DataFrame, prefixes: DataFrame, scratch: Scratch, values: list[str], band: int = BAND) -> DataFrame:
    """(ka, kb, *values): each node's values summed over its subtree.

    nodes: conv, depth, ka, kb and values; conv is any conversation through the node. prefixes: conv, pos, ka, kb of all of them.
    """
    own = prefixes.select(F.col("conv").alias("c"), "pos", (F.col("pos") - F.col("pos") % band).alias("top"), *KEY)
    sums = [F.sum(v).alias(v) for v in values]

    def to_band(rows: DataFrame, top: Column) -> DataFrame:
        """Values to those ancestors (or self) that lie in the band from depth ``top`` on."""
        sent = rows.select("conv", "depth", top.alias("__top"), *values)
        return sent.join(own, (F.col("conv") == F.col("c")) & (F.col("__top") == F.col("top")) & (F.col("pos") <= F.col("depth"))).select(*KEY, *values)

    inner = to_band(nodes, F.col("depth") - F.col("depth") % band).groupBy(*KEY).agg(*sums)
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < band:
        return inner
    inner = scratch.save(inner)
    tops = nodes.where(F.col("depth") % band == 0).select("conv", F.expr(f"depth div {band}").alias("depth"), *KEY).join(inner, list(KEY))
    above = prefixes.where(F.col("pos") % band == 0).withColumn("pos", F.expr(f"pos div {band}"))
    done = scratch.save(rollup(scratch.save(tops), above, scratch, values, band))
    complete = nodes.where((F.col("depth") % band == 0) & (F.col("depth") > 0)).select("conv", "depth", *KEY).join(done, list(KEY))
    return inner.union(to_band(complete, F.col("depth") - band)).groupBy(*KEY).agg(*sums)


def list_digests(rows: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256): SHA-256 of the decimal ids (column conv) of each key, ascending, joined by commas.

    Ids are joined to pieces where a sort by ranges has put them; a list's pieces then stream through one digest, which can't
    be made in parts. A task holds a piece, never a list.
    """

    def join(batches):
        part, n, key, ids = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv"))):
                if (a, b) != key or len(ids) == PIECE:
                    if ids:
                        out.append((*key, part, n, ",".join(ids)))
                    key, ids, n = (a, b), [], n + 1
                ids.append(str(c))
            yield pieces(out)
        yield pieces([(*key, part, n, ",".join(ids))] if ids else [])

    def pieces(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [()] * 5, kinds)], [*KEY, "part", "n", "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids"))):
                if (a, b) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield digests(out)
        yield digests([(*key, sha.hexdigest())] if key else [])

    def digests(out):
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [()] * 3, kinds)], [*KEY, "ends_sha256"])

    order = [*KEY, "conv"]
    joined = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "ka long, kb long, part int, n long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "part", "n").mapInArrow(digest, "ka long, kb long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, scratch: Scratch, band: int = BAND) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv, n (turns; 0 gives a member of the root). turns: conv, pos (1 to n), role, text (digests), cps. No
    conversations, no nodes.
    """
    prefixes = _prefixes(convs, turns, scratch)
    grouped = prefixes.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("cps").alias("cps")
    )
    nodes = scratch.save(grouped)
    inner = nodes.where("depth > 0")
    kids = inner.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("cps")})
    nodes = scratch.save(nodes)
    values = ["n_leaves", "saved_tokens"]
    totals = rollup(nodes.select("conv", "depth", *KEY, *values), prefixes.select("conv", "pos", *KEY), scratch, values, band)
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent_conv_id"))
    out = nodes.drop(*values).join(totals, list(KEY)).join(parents, ["pa", "pb"], "left")
    out = out.join(list_digests(prefixes.where("last")), list(KEY), "left").withColumnRenamed("conv", "conv_id")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*_NODE)


def forked_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose beginnings are forked as ``forked`` says.

    conversations: conv_id, turn (nulls first), role, text (null: empty). Turns of one number are ordered by the MD5 digests of role
    and text. Rows without conv_id take no part; repeated rows are turns of their own; an empty table gives an empty one;
    other columns take no part. Texts are hashed where they are read and never shuffled.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.save(numbered(conversations, scratch))
    convs, rebuilt = forked(turns, scratch)
    return prefix_trie(convs, rebuilt, scratch)
