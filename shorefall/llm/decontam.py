"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton of a block of items is built once and sent to the executors; documents stream through it word by
word, keeping the longest suffix of what was read that occurs in some item. A window of item words ends at a
word exactly where that length reaches the window.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text import raw, small_batches, text_udf, unused

WINDOW = 10
#: Bytes of item text of one automaton; a larger benchmark is passed over in several blocks.
BLOCK_BYTES = 4 << 20
#: ASCII letters and digits (lower-cased) and everything beyond ASCII make words; the rest becomes blanks.
WORDS = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over words; items: (name, words), all with a word at least.

    Its size is linear in the words of the items. Most states have one transition, which two arrays hold; the
    others have a dictionary. An item is listed at the state of each of its windows alone: a match that is
    longer finds that state as its ``top``. Whole items shorter than a window are listed at the state of their
    last word, and found along suffix links through ``shorter``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        self.code: dict[bytes, int] = {}
        #: 0 stands for no state in transitions, as none leads to the root.
        self.link, self.length, self.code1, self.next1 = (array("i", [v]) for v in (-1, 0, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.code.setdefault(w, len(self.code)))
        n = len(self.link)
        length, link = np.frombuffer(self.length, np.int32), np.frombuffer(self.link, np.int32)
        ends, listed, states = set(), array("i"), array("i")
        for name, ws in items:
            s = 0
            for j, w in enumerate(ws):
                s = self._next(s, self.code[w])
                if j + 1 >= window or (len(ws) < window and j + 1 == len(ws)):
                    states.append(s)
                    listed.append(number[name])
            if len(ws) < window:
                ends.add(s)
        top, shorter = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        shorter[list(ends)] = list(ends)
        # by length, so that what a state's suffix link says is known before the state
        for s in np.argsort(length, kind="stable").tolist()[1:]:
            up = link[s]
            if length[up] >= window:
                top[s] = top[up]
            if not shorter[s]:
                shorter[s] = shorter[up]
        self.top, self.shorter = array("i", top.tobytes()), array("i", shorter.tobytes())
        # items by the state of a window or of a whole shorter item
        pairs = np.unique(top[np.frombuffer(states, np.int32)].astype(np.int64) << 32 | np.frombuffer(listed, np.int32)) if len(states) else np.zeros(0, np.int64)
        self.at, first = np.unique(pairs >> 32, return_index=True)
        self.first, self.listed = np.append(first, len(pairs)), (pairs & 0xFFFFFFFF).astype(np.int32)
        self.least = min([window, *(self.length[s] for s in ends)])

    def _next(self, s: int, c: int) -> int:
        if self.code1[s] == c:
            return self.next1[s]
        own = self.more.get(s)
        return own.get(c, 0) if own else 0

    def _lead(self, s: int, c: int, to: int) -> None:
        if self.code1[s] in (-1, c):
            self.code1[s], self.next1[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _new(self, length: int) -> int:
        for held, v in ((self.link, 0), (self.length, length), (self.code1, -1), (self.next1, 0)):
            held.append(v)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._new(length[last] + 1)
        p = last
        while p >= 0 and not (q := self._next(p, c)):
            self._lead(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        own = self._new(self.length[p] + 1)
        self.code1[own], self.next1[own] = self.code1[q], self.next1[q]
        if q in self.more:
            self.more[own] = dict(self.more[q])
        self.link[own], self.link[q] = self.link[q], own
        while p >= 0 and self._next(p, c) == q:
            self._lead(p, c, own)
            p = self.link[p]
        return own

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [a, b) of all occurrences of windows, merged, and the numbers of the items that have them."""
        get = self.code.get
        ids = [get(w, -1) for w in ws]
        known = np.array(ids, np.int64) >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.least:
                self._run(ids, a, b, spans, states)
        found: set[int] = set()
        for k in np.searchsorted(self.at, sorted(states)).tolist():
            found.update(self.listed[self.first[k] : self.first[k + 1]].tolist())
        return merged(spans), found

    def _run(self, ids: list[int], a: int, b: int, spans: list[tuple[int, int]], states: set[int]) -> None:
        code1, next1, more, link, length, window, shorter = self.code1, self.next1, self.more, self.link, self.length, self.window, self.shorter
        none: dict[int, int] = {}
        s = n = 0
        for j in range(a, b):
            c = ids[j]
            while True:
                t = next1[s] if code1[s] == c else more.get(s, none).get(c, 0)
                if t or not s:
                    break
                s = link[s]
                n = length[s]
            s = t
            n = n + 1 if s else 0
            if n >= window:
                states.add(self.top[s])
                spans.append((j + 1 - window, j + 1))
            e = shorter[s]
            while e:
                if length[e] <= n:
                    states.add(e)
                    spans.append((j + 1 - length[e], j + 1))
                e = shorter[link[e]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, name: str = "hits") -> DataFrame:
    """Columns of ``docs`` and ``name``: struct(spans array<int> (flat pairs of word positions), items array<string>), null without a hit.

    benchmark: item_id, text. Items with a null id or without words take no part; repeated ids count once.
    Documents are passed once for each block of items, and written behind each block but the last, so that workers hold one
    automaton at a time. An empty benchmark hits nothing.
    """
    small_batches(docs)
    scratch, sent, saved = Scratch(docs.sparkSession), None, None
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    kind = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    out = docs.withColumn(name, F.lit(None).cast("struct<spans: array<int>, items: array<string>>"))
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).distinct().orderBy("item", "text").collect()
        listed = [(r.item, ws) for r in own if (ws := words(r.text.encode()))]
        if not listed:
            continue
        if sent is not None:
            before, saved = saved, scratch.save(out)
            sent.destroy()
            if before is not None:
                scratch.drop(before)
            out = saved
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(listed, window))  # one block of items

        def make(sent=sent):
            def part(texts: pa.Array, olds: pa.Array) -> pa.Array:
                found = []
                for text, old in zip(raw(texts), olds.to_pylist()):
                    spans, numbers = sent.value.match(words(text))
                    if not spans:
                        found.append(old)
                        continue
                    flat = old["spans"] if old else []
                    both = merged([*zip(flat[::2], flat[1::2]), *spans])
                    names = {sent.value.names[k] for k in numbers}
                    found.append({"spans": [x for s in both for x in s], "items": sorted(names.union(old["items"] if old else []))})
                return pa.array(found, kind)

            return part

        out = out.withColumn(name, text_udf(make, "spans array<int>, items array<string>")(F.col("text"), F.col(name)))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids joined by commas), contaminated.

    Null and empty texts have no words; repeated rows are each reported; null ids stay null; an empty table gives
    an empty one. Other columns of either table play no part.
    """
    found = hits(docs.select("doc_id", "text"), benchmark, window)
    count = text_udf(lambda: lambda texts, _: pa.array([len(words(t)) for t in raw(texts)], pa.int64()), "long")
    side = lambda k: F.aggregate(F.filter("hits.spans", lambda _, i: i % 2 == k), F.lit(0).cast("long"), lambda a, x: a + x)
    hit = F.coalesce(side(1) - side(0), F.lit(0).cast("long"))
    items = F.coalesce("hits.items", F.array().cast("array<string>"))
    sha = F.sha2(F.array_join(items, ","), 256)
    out = found.select(F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text"), F.lit(0)).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), sha.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(WORDS))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.5) -> DataFrame:
    """``docs`` (its columns) with hit spans cut from the texts; documents hit in over ``most`` of their words go.

    Documents without a hit keep their text byte for byte, null and empty ones too. n_chars, where there is
    such a column, follows the text. Repeated rows are each cleaned, null ids stay; an empty table gives an empty
    one. Columns of any name are kept as they are.
    """
    hits_name, cut_name = unused(docs, "hits", "cut")
    found = hits(docs, benchmark, window, hits_name)

    def make():
        def part(texts: pa.Array, spans: pa.Array) -> pa.Array:
            out = []
            for text, flat in zip(texts.to_pylist(), spans.to_pylist()):
                if flat is None:
                    out.append(None)
                    continue
                own, pairs = text.encode(), list(zip(flat[::2], flat[1::2]))
                good = sum(b - a for a, b in pairs) <= most * len(words(own))
                out.append({"keep": good, "text": cut(own, pairs).decode()})
            return pa.array(out, pa.struct([("keep", pa.bool_()), ("text", pa.string())]))

        return part

    hit, fresh_cut = F.col(hits_name).isNotNull(), F.col(cut_name)
    done = text_udf(make, "keep boolean, text string")(F.when(hit, F.col("text")), F.col(hits_name)["spans"])
    found = found.withColumn(cut_name, done).where(~hit | fresh_cut["keep"])
    fresh = {"text": F.when(hit, fresh_cut["text"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(hit, F.length(fresh_cut["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(fresh).select(docs.columns)
