"""Ranked lexical search by a dual tree.

A document's coordinate for a term is its damped frequency, an item's is the term's weight; the score is their inner
product. Items form a hierarchy whose nodes hold the terms of all items below (a term's weight is the same in every
item, so that is the maximum of each coordinate); documents form one, chunk by chunk in the task that reads them, whose
nodes hold the largest coordinate of each term. The product of two nodes bounds every score below both. A pair of nodes
is left as soon as its bound lies under the weakest kth score of the items below it, so whole batches go unscored, and
no pair that could place is left. Floors start with kth scores of a few written parts and rise in each task.

Items are taken in blocks of bounded size, each against all documents. Texts are read once a block; what is written is
a document's frequencies of the block's terms. Nothing but frequencies of document (one number a term of the block),
two totals and floors of the block's items comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..scratch import Scratch
from .text import SLICE_BYTES, Words, buffers, byte_table, release, slices, small_batches

#: Bytes that end a term: all ASCII but letters and digits.
TERM_ENDS = bytes(b for b in range(128) if not chr(b).isalnum())
TERMS = byte_table(TERM_ENDS)
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of a block, and its distinct terms (one item may have more; it is a block of its own then).
BLOCK_ITEMS, BLOCK_TERMS = 512, 8192
#: Documents of a leaf, children of a node (on both sides), documents of a chunk, and its coordinates.
LEAF, FAN, CHUNK, CELLS = 16, 8, 1024, 1 << 23
#: Terms by which documents are put in order: the most frequent ones of a block.
COMMON = 64
#: Written parts that give the first floors.
SEED_PARTS = 4
SALTS = 32


class Vocabulary:
    """Terms of a block, found by 64-bit hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw])
        w = Words(data, np.array([0, len(data)]), TERMS)
        assert len(w.start) == len(raw) and (w.end == ends - 1).all(), "a term holds a byte that ends terms"
        order = np.argsort(w.hash, kind="stable")
        self.hash, self.id, self.data, self.start, self.length = w.hash[order], order.astype(np.int64), data, w.start[order], (w.end - w.start)[order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms here, and the terms' numbers."""
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        length = words.end - words.start
        some = np.flatnonzero((self.hash[at] == words.hash) & (self.length[at] == length))
        at, length = at[some], length[some]
        if not len(some):
            return some, at
        first = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(first, length)
        same = words.seen[np.repeat(words.start[some], length) + inside] == self.data[np.repeat(self.start[at], length) + inside]
        whole = np.logical_and.reduceat(same, first)
        return some[whole], self.id[at[whole]]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is, or one long text in parts that end behind a term."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and TERMS[data[end]]:
            ends = np.flatnonzero(TERMS[data[end : end + SLICE_BYTES]] == 0)
            end = end + int(ends[0]) if len(ends) else min(len(data), end + SLICE_BYTES)
        yield data[at:end], np.array([0, end - at])
        at = end


def frequencies(docs: DataFrame, terms: list[str], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): documents with a term, their number of terms with repeats, and frequencies of the given ones."""

    def run(batches):
        words = Vocabulary(terms)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                n, found = np.zeros(len(part), np.int64), []
                for own, off in _pieces(data, offsets):
                    w = Words(own, off, TERMS)
                    n += np.diff(w.first)
                    place, term = words.find(w)
                    found.append(np.unique(w.doc[place] * len(terms) + term, return_counts=True))
                if len(found) > 1:
                    pair, place = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                    tf = np.bincount(place, np.concatenate([c for _, c in found]), len(pair)).astype(np.int64)
                else:
                    pair, tf = found[0]
                ends = pa.array(np.searchsorted(pair, np.arange(len(part) + 1) * len(terms)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % len(terms), tf)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
        release()

    read = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The k best documents of each item so far; ``floor`` is the kth score, or 1 while there are fewer."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, id, id is null
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = score >= self.floor[item]
        if some.any():
            self.new.append((np.full(int(some.sum()), item), score[some], ids[some], null[some]))
            self.waiting += int(some.sum())

    def settle(self) -> None:
        if not self.new:
            return
        item, score, ids, null = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        order, item = order[rank < self.k], item[rank < self.k]
        self.kept = [item, score[order], ids[order], null[order]]
        last = rank[rank < self.k] == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], self.kept[1][last])
        self.new, self.waiting = [], 0


class Items:
    """A hierarchy over the items of a block; levels from the root to single items, each node with its terms."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        heavy = sum(weight.tolist()) * 10**6 >= 1 << 53  # such sums are not exact in doubles
        self.weight = weight.astype(np.int64 if heavy else np.float64)
        common = np.argsort(weight, kind="stable")[:COMMON]  # the lightest terms are the most frequent ones
        place = np.full(len(weight), COMMON)
        place[common] = np.arange(len(common))
        # items that share frequent terms stand together
        order = sorted(range(len(terms)), key=lambda i: (sorted(place[terms[i]])[:4], i))
        self.levels = [[(np.array([i]), terms[i]) for i in order]]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            groups = [below[i : i + FAN] for i in range(0, len(below), FAN)]
            self.levels.insert(0, [(np.concatenate([g[0] for g in own]), np.unique(np.concatenate([g[1] for g in own]))) for own in groups])
        self.common = common


class Search:
    """Documents of one task against the items of a block."""

    def __init__(self, items: Items, best: Best, documents: int, terms: int):
        self.items, self.best, self.documents, self.terms = items, best, documents, terms
        self.bounds = self.scored = 0  # pairs looked at, for reports

    def chunk(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        if not len(term):
            return
        damp = 50 * self.documents
        long = n.astype(object) if damp * int(n.max()) >= 1 << 63 else n
        m = 50 + (damp * long // self.terms).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        tf = tf.astype(np.int64)
        value = 10**9 * tf // (1000 * tf + 20 * m[doc])
        # documents alike in their heaviest frequent term and in length stand together, so that maxima stay low
        common = np.full(len(self.items.weight), -1)
        common[self.items.common] = np.arange(len(self.items.common))
        lead, some = np.full(len(n), -1), np.flatnonzero(common[term] >= 0)
        rising = some[np.argsort(value[some] * self.items.weight[term[some]], kind="stable")]
        lead[doc[rising]] = common[term[rising]]
        order = np.lexsort((m, lead))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        ids, null = ids[order], null[order]
        leaves = -(-len(n) // LEAF)
        flat = np.zeros((len(self.items.weight), leaves * LEAF), np.float32)  # coordinates are below 2^24
        flat[term, place[doc]] = value
        levels = [flat.reshape(len(flat), leaves, LEAF)]
        levels.insert(0, levels[0].max(axis=2))
        while levels[0].shape[1] > 1:
            below = levels[0]
            room = np.zeros((len(flat), -(-below.shape[1] // FAN) * FAN), np.float32)
            room[:, : below.shape[1]] = below
            levels.insert(0, room.reshape(len(flat), -1, FAN).max(axis=2))
        self.ids, self.null, self.levels = ids, null, levels
        self.visit(0, 0, 0, np.array([0]))
        self.best.settle()

    def visit(self, depth: int, node: int, level: int, there: np.ndarray) -> None:
        """An item node against document nodes of a level: bounds, then the children of those that stay."""
        own, terms = self.items.levels[depth][node]
        weight, kind = self.items.weight[terms], self.items.weight.dtype
        bound = weight @ self.levels[level][np.ix_(terms, there)].astype(kind)
        self.bounds += len(there)
        there = there[bound >= self.best.floor[own].min()]
        if not len(there):
            return
        last = len(self.levels) - 2
        if depth + 1 < len(self.items.levels):  # on the items' side first where documents are down at the leaves
            down = level < last
            below = self.children(level, there) if down else there
            for child in range(node * FAN, min((node + 1) * FAN, len(self.items.levels[depth + 1]))):
                self.visit(depth + 1, child, level + down, below)
        elif level < last:
            self.visit(depth, node, level + 1, self.children(level, there))
        else:
            values = self.levels[-1][np.ix_(terms, there)].reshape(len(terms), -1).astype(kind)
            score = (weight @ values).astype(np.int64)
            docs = (there[:, None] * LEAF + np.arange(LEAF)).ravel()
            whole = docs < len(self.ids)
            self.scored += int(whole.sum())
            self.best.add(int(own[0]), score[whole], self.ids[docs[whole]], self.null[docs[whole]])
            if self.best.waiting > 1 << 16:
                self.best.settle()

    def children(self, level: int, there: np.ndarray) -> np.ndarray:
        below = (there[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < self.levels[level + 1].shape[1]]


def _search(found: DataFrame, block: list[list[int]], weight: list[int], documents: int, terms: int, k: int, floor: list[int]) -> DataFrame:
    """(item, doc_id, score): the k best of each task."""
    room = max(LEAF, min(CHUNK, CELLS // max(1, len(weight)) // LEAF * LEAF))

    def run(batches):
        best = Best(k, np.array(floor, np.int64))
        own = Search(Items([np.array(t) for t in block], np.array(weight, np.int64)), best, documents, terms)
        for batch in batches:
            for at in range(0, len(batch), room):
                part = batch.slice(at, room)
                ids = part.column("doc_id")
                t, f = part.column("terms"), part.column("tfs")
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))])
                args = [t.flatten().to_numpy(zero_copy_only=False), f.flatten().to_numpy(zero_copy_only=False)]
                own.chunk(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(zero_copy_only=False), ends, *args)
        item, score, ids, null = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=null), pa.array(score)], ["item", "doc_id", "score"])
        release()

    return small_batches(found).mapInArrow(run, "item int, doc_id long, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; in parts first, so that what many tasks found of one item does not meet at once."""
    place = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = rows.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*place))).where(F.col("r") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*place))).where(F.col("rank") <= k).drop("salt", "r")


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[list[int]], list[str]]]:
    """(ids, numbers of each item's terms, terms) of one block after the other; the driver holds one block, and a part of the items."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0))
    rows = items.select(F.col(item_id).alias("id"), F.array_distinct(found).alias("terms")).where("size(terms) > 0")
    ids, own, number = [], [], {}
    for r in rows.toLocalIterator():
        new = [t for t in r.terms if t not in number]
        if ids and (len(ids) == BLOCK_ITEMS or len(number) + len(new) > BLOCK_TERMS):
            yield ids, own, list(number)
            ids, own, number = [], [], {}
        own.append([number.setdefault(t, len(number)) for t in r.terms])
        ids.append(r.id)
    if ids:
        yield ids, own, list(number)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, those with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased. Ids of documents are
    integers. Ties go to the smaller id, a null id comes last; rows that repeat an id are documents of their own. Each
    row of items is an item, also where ids repeat. Null and empty texts have no terms; items without terms or without
    a document, and empty tables, give no rows. Other columns take no part. A text is read in parts of about 1 MB.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = items.schema[item_id].dataType
    out: DataFrame | None = None
    for ids, block, terms in _blocks(items, item_id, item_text):
        found = scratch.save(frequencies(docs, terms, doc_id, text))
        total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total.n:
            scratch.drop(found)
            break
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one number a term of the block
        weight = [math.floor(1000 * math.log((2 * total.n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))]
        search = lambda rows, floor: _search(rows, block, weight, total.n, total.terms, k, floor)  # noqa: B023, E731
        files = found.inputFiles()
        seed = spark.read.schema(found.schema).parquet(*files[:: -(-len(files) // SEED_PARTS)])
        kth = _top(search(seed, [1] * len(ids)), k).where(F.col("rank") == k).select("item", "score").collect()  # one number an item
        floor = [1] * len(ids)
        for r in kth:
            floor[r.item] = r.score
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
        best = _top(search(found, floor), k).join(F.broadcast(names), "item")
        best = scratch.save(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        scratch.drop(found)
        out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "*")
    return out

