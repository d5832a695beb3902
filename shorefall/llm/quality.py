"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Features are hashed indicators of a document: its words and word pairs, its word shapes (letters and digits
folded, so "Abc!!" is "Aa!!"), pairs of shapes, and coarse shares of each shape and of repeated pairs. Labelled
documents give each indicator's log-count ratio r; each document is its indicators times r, at unit length; the
model is fitted by dual coordinate descent, and a logistic curve over margins of held-back training documents
turns margins into scores (Wang and Manning, 2012; Hsieh et al., 2008).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .sample import bounded
from .text import ODD, SPACED, Words, buffers, map_slices, mix, small_batches, text_udf, unused

#: Labelled documents used for fitting at most, and features of theirs that come to the driver at most.
SAMPLE, FEATURES = 8000, 1 << 24
BUCKETS = 1 << 18
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
THRESHOLD = 0.7

#: Bytes folded to shapes: a lower case and beyond ASCII, A upper case, 0 digit; other bytes stay.
SHAPES = np.array([97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in range(256)], np.uint8)


class _Rows:
    """Collects (row, bucket) of hashed features."""

    def __init__(self):
        self.keys: list[np.ndarray] = []

    def add(self, row: np.ndarray, hashed: np.ndarray, kind: int) -> None:
        bucket = mix(hashed + np.array([kind], np.uint64) * ODD) & np.uint64(BUCKETS - 1)
        self.keys.append(row.astype(np.uint64) << np.uint64(32) | bucket)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _folded(data: np.ndarray, words: Words) -> np.ndarray:
    """Hash of each word's shape: runs of one folded byte count as one."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    shape = SHAPES[data]
    first = np.ones(len(data), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[words.start] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    data2 = shape[first]
    sums = np.zeros(len(data2) + 1, np.uint64)
    power = np.full(len(data2) + 1, ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(data2) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    np.cumsum((data2.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    a, b = kept[words.start], kept[words.end]
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def _bins(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How large a share is: 0 (none) to 6."""
    return np.searchsorted([0.0, 0.005, 0.02, 0.08, 0.2, 0.5], count / np.maximum(of, 1), "left").astype(np.uint64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of each text, by row. Null is the empty text; both have one feature."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    out = _Rows()
    rows = np.arange(n)
    out.add(rows, np.zeros(n, np.uint64), 0)
    words = Words(data, offsets, SPACED)
    if not len(words.start):
        for kind in (6, 7):
            out.add(rows, np.zeros(n, np.uint64), kind)
        return out.distinct()
    out.add(words.doc, words.hash, 1)
    two, whole = words.shingles(2)
    out.add(words.doc[whole], two[whole], 2)
    shape = _folded(data, words)
    out.add(words.doc, shape, 3)
    pair = mix(shape[:-1] * ODD + shape[1:])[whole[:-1]]
    at = words.doc[:-1][whole[:-1]]
    out.add(at, pair, 4)
    n_words = np.bincount(words.doc, minlength=n)
    # shares of each shape, and of words that repeat an earlier one of the text or the one before
    key = words.doc.astype(np.uint64) << np.uint64(40) | shape >> np.uint64(24)
    seen, first, count = np.unique(key, return_index=True, return_counts=True)
    doc = words.doc[first]
    out.add(doc, shape[first] + _bins(count, n_words[doc]), 5)
    wkey = words.doc.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24)
    again = n_words - np.bincount((np.unique(wkey) >> np.uint64(40)).astype(np.int64), minlength=n)
    out.add(rows, _bins(again, n_words), 6)
    same = np.bincount(at[(words.hash[:-1] == words.hash[1:])[whole[:-1]]], minlength=n)
    out.add(rows, _bins(same, n_words), 7)
    return out.distinct()


class Model:
    """r: log-count ratios; weights: r times the hinge model's; slope and base of the logistic curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        if len(set(labels.tolist())) < 2:  # one class or none: that class's share
            self.r, self.weights, self.bias, self.slope = np.zeros(BUCKETS), np.zeros(BUCKETS, np.float32), 0.0, 0.0
            self.base = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
            return
        back = np.arange(len(rows)) % 4 == 3  # held back for the curve; rows come in hash order
        if len(set(labels[~back].tolist())) < 2 or len(set(labels[back].tolist())) < 2:
            back[:] = False
        self._fit([x for x, h in zip(rows, back) if not h], labels[~back])
        of = back if back.any() else ~back
        margins = np.array([self._margin(x) for x, h in zip(rows, of) if h])
        self._curve(margins, labels[of])

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        count = np.full((2, BUCKETS), SMOOTH)
        for x, y in zip(rows, labels):
            count[y, x] += 1
        self.r = (np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())).astype(np.float64)
        self.r[(count.sum(axis=0)) == 2 * SMOOTH] = 0  # never seen
        values = [self._scaled(x) for x in rows]
        w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
        sign = np.where(labels == 1, 1.0, -1.0)
        rare = len(labels) / (2 * np.bincount(labels, minlength=2))  # both classes weigh alike
        upper = COST * rare[labels]
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                x, v = rows[i], values[i]
                g = sign[i] * (w[x] @ v + bias) - 1
                new = min(max(alpha[i] - g / (v @ v + 1.0), 0.0), upper[i])
                if new != alpha[i]:
                    step = (new - alpha[i]) * sign[i]
                    w[x] += step * v
                    bias += step
                    alpha[i] = new
        self.weights, self.bias = w * self.r, bias

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        v = self.r[x]
        return v / max(np.sqrt(v @ v), 1e-9)

    def _margin(self, x: np.ndarray) -> float:
        v = self.r[x]
        return float(self.weights[x].sum() / max(np.sqrt(v @ v), 1e-9) + self.bias)

    def _curve(self, margin: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the label on the margin, by Newton steps on smoothed targets."""
        n1 = labels.sum()
        t = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
            q = p * (1 - p)
            h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.base = float(a), float(b)

    def score(self, column: pa.Array) -> np.ndarray:
        row, bucket = features(column)
        n = len(column)
        total = np.bincount(row, self.weights[bucket], n)
        size = np.sqrt(np.bincount(row, self.r[bucket] ** 2, n))
        margin = total / np.maximum(size, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.base, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most SAMPLE labelled documents (doc_id, text with doc_id, quality), chosen by hash.

    Labels that are null or not 0 or 1, and null ids, take no part; of labels that repeat an id the smallest
    counts, of repeated documents the smallest list of features. Only features come to the driver, FEATURES at most:
    documents beyond are left out, in the order of the hash.
    """
    given = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded(given, SAMPLE, "doc_id")

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            row, bucket = features(b.column(2))
            ends = np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32)))], ["doc_id", "quality", "x"])

        return part

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")  # SAMPLE rows at most
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(map_slices(rows, "text", make, "doc_id long, quality int, x array<int>"))
    place = lambda i: int(mix(np.array([i], np.int64).view(np.uint64))[0])
    sizes = sorted((place(r.doc_id), r.doc_id, r.n) for r in found.groupBy("doc_id").agg(F.sum(F.size("x")).alias("n")).collect())  # SAMPLE rows at most
    total = np.cumsum([n for *_, n in sizes])
    ids = [i for (_, i, _), t in zip(sizes, total.tolist()) if t <= FEATURES]
    kept = found if len(ids) == len(sizes) else found.where(F.col("doc_id").isin(ids))
    got = kept.toArrow().combine_chunks()
    scratch.drop(found)
    doc, quality, x = (got.column(i) for i in range(3))
    first: dict[int, tuple[list[int], int]] = {}
    for i, d in enumerate(doc.to_pylist()):
        own = (x[i].values.to_numpy(), quality[i].as_py())
        if d not in first or own[0].tolist() < first[d][0].tolist():
            first[d] = own
    ordered = [first[d] for d in sorted(first, key=place)]
    return Model([v.astype(np.int64) for v, _ in ordered], np.array([y for _, y in ordered], np.int64))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Columns of ``docs`` and ``name``, 0 to 1. Null texts score as the empty text; repeated rows are each scored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, twice
    small_batches(docs)
    score = text_udf(lambda: lambda text, _: pa.array(sent.value.score(text)), "double")
    return docs.withColumn(name, score(F.col("text"), F.lit(0)))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the model learns from labels of rows that are not held out.

    A null id is not held out; repeated rows are each scored; without labels of both classes the score is that
    of the class seen, or a half. An empty table gives an empty one; other columns take no part.
    """
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (its columns, whatever their names) that the classifier predicts good.

    Null and empty texts are judged as the empty text, repeated rows each; rows with a null id are judged too. An
    empty table gives an empty one.
    """
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    (name,) = unused(docs, "score")
    return scored(docs, model, name).where(F.col(name) >= THRESHOLD).select(docs.columns)
