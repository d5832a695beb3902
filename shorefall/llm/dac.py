"""Token ids as directly addressable codes.

A block of ids is split into levels of eight bits. Level 0 has the low bits of every id, level 1 the next bits
of those ids that have any, and so on; beside each level stands a bitmap of the ids that go on, and a directory
of the ones before each 512 bits of it. The place of an id in the next level is the rank of its bit, so any
token is read from a few bytes without decoding the block (Brisaboa, Ladra, Navarro, 2013).

A written table has one row for each block: part, block, doc_ids, counts, payload; parts and blocks go up with
doc_id, and a document lies whole in one block.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..scratch import Scratch
from .text import buffers, slices, small_batches

BITS, RANKED = 8, 512
#: Ids of a block, about (a longer document makes a longer block).
BLOCK_IDS = 1 << 20
#: Words and letter runs that one generation of a worker's tables keeps, the longest kept, and the bytes of text encoded at once.
TABLE, STEMS, LONGEST, PART_BYTES = 150_000, 150_000, 64, 1 << 22
#: An id that no model has; stands for a word whose ids depend on the text around it.
UNUSED = 2**32 - 1
WHOLE = array("I", [UNUSED]).tobytes()
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END = 0
#: How byte-level models write bytes: printable ones of Latin-1 as themselves, the others in order from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def pack(ids: np.ndarray) -> bytes:
    """Payload of a block of ids (each below 2^32): number of levels, sizes of levels, then level by level."""
    left = np.asarray(ids, np.uint64)
    levels = []
    while True:
        more = left >> np.uint64(BITS)
        goes_on = more > 0
        levels.append(((left & np.uint64(255)).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        left = more[goes_on]
    out = [np.array([len(levels), *(len(x) for x, _ in levels)], "<u4").tobytes()]
    for low, goes_on in levels:
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANKED), dtype=np.int64) if len(goes_on) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        out += [low.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """A payload opened: ``codes[i]`` reads one id, ``all()`` every id."""

    def __init__(self, payload: bytes):
        n = int(np.frombuffer(payload, "<u4", 1)[0])
        sizes = np.frombuffer(payload, "<u4", n, 4).tolist()
        at, self.levels, self.n = 4 + 4 * n, [], sizes[0]
        for size in sizes:
            low = np.frombuffer(payload, np.uint8, size, at)
            at += size
            bits = np.frombuffer(payload, np.uint8, -(-size // 8), at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-size // RANKED), at)
            at += 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for low, bits, ranks in self.levels:
            out |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANKED * (RANKED // 8)
            own = bits[first : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[i // RANKED]) + int(np.bitwise_count(own).sum())
            shift += BITS
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(BITS * k)
            at = at[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)]
        return out


class Recent:
    """A table of two generations: what is asked for again moves to the younger; when that is full, the older goes."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of distinct keys; ``make`` gives those of unknown ones."""
        out = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        asked = [keys[i] for i in missing]
        again = list(map(self.old.get, asked))
        made = iter(make([k for k, v in zip(asked, again) if v is None]))
        values = [next(made) if v is None else v for v in again]
        for i, v in zip(missing, values):
            out[i] = v
        if max(map(len, asked)) <= LONGEST:
            self.young.update(zip(asked, values))
        else:
            self.young.update([(k, v) for k, v in zip(asked, values) if len(k) <= LONGEST])
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


class Encoder:
    """Ids of whole texts from the tokenizers library, each distinct word encoded once while the tables hold it.

    The model's pattern never takes a blank into a piece unless the blank begins it, or white space ends there;
    and a line feed between other characters is a piece of its own. So a text may be cut before each blank that
    has other than white space on one side, and around single line feeds; its ids are those of the chunks.
    """

    LINES = 512

    def __init__(self, model: str):
        self.lib = Tokenizer.from_str(model)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.feed = self.lib.encode("\n", add_special_tokens=False).ids
        self.line = self._bytes(self.feed)
        #: Ids of letters, and of words with more than that, with the blank or the line feed before them; WHOLE: white
        #: space in or about a word needs the whole text.
        self.stems, self.words = Recent(STEMS), Recent(TABLE)
        self.tails = Recent(TABLE // 10)  # marks behind letters
        # a check that the model reads bytes as SHOWN has them
        tried = ["a", "é", "ß中", "ization", "İ"]
        self.direct = True
        self.direct = self._pieces(" ", tried) == [self._bytes(self.lib.encode(" " + t, add_special_tokens=False).ids) for t in tried]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def chunks(self, text: str) -> list[str]:
        """Chunks of any text, each with the blank before it."""
        parts = text.split(" ")
        out = parts[:1]
        for before, behind in zip(parts, parts[1:]):
            if (not before or before[-1].isspace()) and (not behind or behind[0].isspace()):
                out[-1] += " " + behind
            else:
                out.append(" " + behind)
        return out

    def _lines(self, before: str, words: list[str]) -> list[bytes]:
        """Ids of words that hold no line feed."""
        out = []
        for i in range(0, len(words), self.LINES):
            group = words[i : i + self.LINES]
            ids = np.array(self.lib.encode("\n".join([before + w for w in group]), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(ids == self.feed[0]).tolist() if len(self.feed) == 1 else []
            if len(at) == len(group) - 1:
                whole = ids.tobytes()
                out += [whole[4 * a + 4 : 4 * b] for a, b in zip([-1, *at], [*at, len(ids)])]
            else:
                out += [self._bytes(self.lib.encode(before + w, add_special_tokens=False).ids) for w in group]
        return out

    def _pieces(self, before: str, stems: list[str]) -> list[bytes]:
        """Ids of runs of letters: each is one piece of the pattern, so the library's model takes it as it stands."""
        if not self.direct:
            return self._lines(before, stems)
        shown = lambda s: s.encode().decode("latin-1").translate(SHOWN)
        tokens, begin = self.lib.model.tokenize, shown(before)
        odd = [i for i, s in enumerate(stems) if not s.isascii()]
        if odd:  # no letter has the byte of a blank
            stems = stems.copy()
            for i, s in zip(odd, shown(" ".join([stems[i] for i in odd])).split(shown(" "))):
                stems[i] = s
        return [array("I", [t.id for t in tokens(begin + s)]).tobytes() for s in stems]

    def _letters(self, new: list[str]) -> list[bytes]:
        """Ids of runs of letters, each with the line feed or else the blank before it; WHOLE for what is no such run."""
        out = [WHOLE] * len(new)
        at = [i for i, s in enumerate(new) if s.isalpha()]
        for i, ids in zip(at, self._pieces(" ", [new[i] for i in at])):
            out[i] = ids
        at = [i for i, s in enumerate(new) if s[:1] == "\n" and s[1:].isalpha()]
        for i, ids in zip(at, self._pieces("", [new[i][1:] for i in at])):
            out[i] = self.line + ids
        return out

    def _others(self, new: list[str]) -> list[bytes]:
        """Ids of words that are more than letters and marks behind them."""
        out = dict.fromkeys(new, WHOLE)
        for before, begin in ((" ", b""), ("", self.line)):
            words = [w for w in new if (w[:1] == "\n") == bool(begin)]
            bodies = [w[1:] if begin else w for w in words]
            rest = [(w, b) for w, b in zip(words, bodies) if b.split() == [b]]
            out.update((w, begin + ids) for (w, _), ids in zip(rest, self._lines(before, [b for _, b in rest])))
        return list(out.values())

    def _marks(self, new: list[str]) -> list[bytes]:
        """Ids of marks behind letters; most words have none."""
        some = iter(self._lines("", [t for t in new if t]))
        return [next(some) if t else b"" for t in new]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size, whole) of distinct words: two runs of ids each, of the letters and of the marks behind them.

        Letters and marks are pieces of their own, so each is encoded once. whole: the text around the word is needed.
        """
        stems = pc.ascii_rtrim(words, characters=MARKS)
        data, offsets = buffers(words)
        tail = offsets[1:] - offsets[:-1] - pc.binary_length(stems).to_numpy()
        ends = np.concatenate([[0], np.cumsum(tail)])
        letters = data[np.repeat(offsets[1:] - ends[1:], tail) + np.arange(ends[-1])]
        tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters))
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        known = self.stems.look_up(stems.dictionary.to_pylist(), self._letters)
        marks = self.tails.look_up(tails.dictionary.to_pylist(), self._marks)
        at = np.stack([stems.indices.to_numpy(), len(known) + tails.indices.to_numpy()], axis=1)
        others = np.flatnonzero(np.array([k == WHOLE for k in known], bool)[at[:, 0]])
        rest = self.words.look_up(words.take(pa.array(others)).to_pylist(), self._others)
        at[others, 0] = len(known) + len(marks) + np.arange(len(rest))
        every = known + marks + rest
        size = np.fromiter(map(len, every), np.int64, len(every)) // 4
        begin = (np.cumsum(size) - size)[at]
        size = size[at]
        size[others, 1] = 0
        whole = np.zeros(len(words), bool)
        whole[others] = [k == WHOLE for k in rest]
        return np.frombuffer(b"".join(every), "<u4"), begin, size, whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): unsigned 32-bit ids of all texts in a row (null: none), and where each text's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # words, each with the line feed before it, if there is one; a text begins like a line
        feed, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(nothing, texts, feed), "\n", " \n"), " ")
        words = split.flatten().dictionary_encode()
        values, begin, size, whole = self._of_words(words.dictionary)
        at = words.indices.to_numpy()
        n = split.value_lengths().to_numpy().astype(np.int64) - 1  # the first is what stands before the added line feed
        first = np.cumsum(n) - n
        keep = np.ones(len(at), bool)
        keep[first + np.arange(len(n))] = False
        at = at[keep]
        src, took = begin[at], size[at]
        src[first, 0] += len(self.feed)
        took[first, 0] = np.maximum(took[first, 0] - len(self.feed), 0)
        src, took = src.ravel(), took.ravel()
        sums = np.cumsum(took)
        ids = values[np.repeat(src - (sums - took), took) + np.arange(sums[-1])]
        ends = sums[2 * (first + n) - 1]
        odd = np.flatnonzero(np.add.reduceat(whole[at], first, dtype=np.int64))
        if len(odd):
            parts = np.split(ids, ends[:-1])
            for i in odd.tolist():
                own = [e.ids for e in self.lib.encode_batch(self.chunks(texts[i].as_py()), add_special_tokens=False)]
                parts[i] = np.concatenate([np.array(x, np.uint32) for x in own])
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, model: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def write(docs: DataFrame, tokenizer_path: str, scratch: Scratch, end: int = END) -> DataFrame:
    """Encodes doc_id, text, appends the end id, and writes blocks in ascending doc_id order (ties by text)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash(model)

    def run(batches):
        own, part = _encoder(key, sent.value), TaskContext.get().partitionId()
        held, ids, counts, n, block = [], [], [], 0, 0

        def row():
            payload = pack(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int32()), (np.concatenate(ids), pa.list_(pa.int64())), (np.concatenate(counts), pa.list_(pa.int64())), (payload, pa.binary()))],
                ["part", "block", "doc_ids", "counts", "payload"],
            )

        for batch in batches:
            for cut in slices(batch, "text", PART_BYTES):
                got, ends = own.encode(cut.column(1))
                got = np.insert(got, ends, end)
                ends, doc, at, taken = ends + np.arange(1, len(ends) + 1), cut.column(0).to_pylist(), 0, 0
                while at < len(ends):  # a block takes the document that fills it whole
                    to = min(len(ends), int(np.searchsorted(ends, taken + BLOCK_IDS - n)) + 1)
                    held.append(got[taken : ends[to - 1]])
                    ids.append(np.array(doc[at:to], object))
                    counts.append(np.diff(ends[at:to], prepend=taken))
                    n, at, taken = n + len(held[-1]), to, int(ends[to - 1])
                    if n >= BLOCK_IDS:
                        yield row()
                        held, ids, counts, n, block = [], [], [], 0, block + 1
        if held:
            yield row()

    small_batches(docs)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(ordered.mapInArrow(run, "part int, block int, doc_ids array<long>, counts array<long>, payload binary"), "none")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from written blocks."""
    sizes = blocks.select("part", "block", F.expr("aggregate(counts, 0L, (a, b) -> a + b)").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                part, block, docs, counts, payload = (c[i].as_py() for c in batch.columns)
                ids, ends = Codes(payload).all().astype("<u4").tobytes(), np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes and reads back. Null text counts as empty (the end id alone); null ids come first; rows may repeat.

    An empty table gives an empty one. Other columns take no part.
    """
    return read(write(docs, tokenizer_path, Scratch(docs.sparkSession)))
