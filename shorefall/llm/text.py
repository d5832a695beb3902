"""Whole texts as Arrow byte buffers: bounded slices of batches, words and their hashes in NumPy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task (NumPy needs some fifty times that); one longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows that go to Python at once at most.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text (one row at least)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives memory that a finished task has freed back to the system; a reused worker would else keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session, in rows and bytes, so that long texts do not fill the executors' memory.

    The settings stay, as plans made from ``df`` read them when they run.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        had = str(conf.get(key)).lower()
        if not had.removesuffix("b").isdigit() or not 0 < int(had.removesuffix("b")) <= most:
            conf.set(key, str(most))
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def map_slices(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; ``make`` builds the function once a task."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield f(part)
        release()

    return small_batches(df).mapInArrow(run, schema)


def text_udf(make: Callable[[], Callable[..., pa.Array]], kind: str):
    """An Arrow UDF of a text and other columns, over bounded slices; ``make`` builds the function once a task.

    Rows stay in the JVM, only the arguments go to Python and only the result comes back.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for columns in batches:
            batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
            parts = [f(*part.columns) for part in slices(batch, "0")]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0)
        release()

    return F.arrow_udf(run, kind)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column in a row, and the offsets of its texts (null: empty)."""
    c = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = c.buffers()
    off = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(c) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of many texts: ``start``/``end`` byte positions, ``doc`` row of each, ``hash`` 64-bit, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        """table: 256 bytes; a byte that maps to 0 separates words, others are read as what they map to."""
        seen = table[data]
        word = seen != 0
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
        self.start = np.flatnonzero(word & (~before | begins[:n]))
        self.end = np.flatnonzero(word & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((seen.astype(np.uint64) + np.uint64(1)) * powers(ODD, n)[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(INVERSE, n)[self.start] + (self.end - self.start).astype(np.uint64))
        self.seen = seen

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        whole = np.zeros(n, bool)
        m = max(0, n - k + 1)
        for i in range(k):
            out[:m] = mix(out[:m] * ODD + self.hash[i : i + m])
        if m:
            whole[:m] = self.doc[:m] == self.doc[k - 1 :]
        return out, whole


def byte_table(separators: bytes) -> np.ndarray:
    """A-Z read as a-z; the given bytes, and the byte 0, separate words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators) or [0]] = 0
    return t


#: Words are what stands between ASCII white space.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: The same for ``bytes.translate``, which keeps white space for ``split``.
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
