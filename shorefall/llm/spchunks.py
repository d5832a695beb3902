"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a white-space marker behind another character, so no piece crosses from a word
into the next marker, and BPE merges never do either: a text is cut before each run of blanks, each distinct
chunk is segmented once by the library, and ids are joined back by position. The table lives in the worker, in two
generations of bounded size: chunks that come again stay, others go, so a task's memory does not grow with the corpus and
texts need no shuffle.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .dac import Recent
from .text import map_slices

MARK = "▁"
#: Chunks of a generation of a worker's table, and bytes of text handled at once.
TABLE, PART_BYTES = 60_000, 1 << 19
RUNS = re.compile(" +[^ ]+")


def chunks(text: str) -> list[str] | None:
    """Chunks of a text, each without the one blank (or the text's begin) before it.

    None where cutting is not safe (blanks at the end, or the marker itself in the text).
    """
    if MARK in text:
        return None
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return None if text[-1:] == " " else [c[1:] for c in RUNS.findall(" " + text)]


class ChunkTable:
    """chunk -> (number of ids, ids as decimals joined by commas, decoded chunk)."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.table = Recent(TABLE)

    def rows(self, ids: list[list[int]]) -> list[tuple[int, str, str]]:
        return [(len(x), ",".join(map(str, x)), d) for x, d in zip(ids, self.sp.decode(ids))]

    def look_up(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n, ids, decoded) of each whole text."""
        cut = [chunks(t) if self.cuts else None for t in texts]
        distinct = set().union(*(c for c in cut if c))
        lines = [c for c in distinct if "\n" in c]  # these hardly ever come again
        words = list(distinct.difference(lines))
        make = lambda new: self.rows(self.sp.encode(new, num_threads=1)) if new else []
        table = dict(zip(words, self.table.look_up(words, make))) | dict(zip(lines, make(lines)))
        out = []
        for text, own in zip(texts, cut):
            if own is None:
                out += self.rows([self.sp.encode(text, num_threads=1)])
            else:
                got = [table[c] for c in own]
                out.append((sum([g[0] for g in got]), ",".join([g[1] for g in got if g[0]]), " ".join([g[2] for g in got])))
        return out


_tables: dict[int, ChunkTable] = {}


def _table(key: int, model: bytes) -> ChunkTable:
    """One table for each worker and model; later tasks of a reused worker find it filled."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(model)
    return _tables[key]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null text counts as empty, a null id stays null.

    Repeated rows are each encoded; an empty text has no ids and the hashes of the empty string. An empty table gives an empty
    one; other columns play no part. A long text is cut into chunks whole, some ten times its size in memory.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash(model)

    def make():
        own = _table(key, sent.value)

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            got = own.look_up([t or "" for t in b.column(1).to_pylist()])
            sha = lambda i: pa.array([hashlib.sha256(g[i].encode()).hexdigest() for g in got], pa.string())
            return pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.int64()), sha(1), sha(2)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return part

    return map_slices(docs.select("doc_id", "text"), "text", make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", PART_BYTES)
