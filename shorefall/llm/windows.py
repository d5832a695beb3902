"""Near-duplicate passages across documents by compact windows.

Tokens are 5-word shingles. For one hash function, every stretch of at least LEAST shingles of a text has one
smallest hash; the stretches whose smallest shingle is c are those between the next smaller hashes on both
sides that hold c. So a text of n shingles has about 2n / LEAST compact windows (l, c, r): the nodes of the
Cartesian tree over its hashes that span LEAST shingles. Two stretches share a min-hash only if the windows
that they lie in do.

Windows of different documents with one value are tied: all pairs of them where the value has FEW windows or
fewer, else those of each document to the smallest document that has the value, and to the smallest that also
has the same words before or behind it. Tied windows of a pair of documents are joined as intervals; where
those of enough hash functions overlap, the stretches are read again and compared: similarity of 0.8 or more of
their shingle sets (by 32-bit hashes of shingles). Each pair of distinct stretches is compared once, however
many documents have them.

The smallest document with a frequent value need not hold the passage around it. So the spots around such windows,
where a shingle lies in no verified passage, and around all others of their values are indexed by shingles (equal
spots once). Of LEAST shingles in a row of a similar passage MATCHED have a match or more, so one of the rarest LEAST -
MATCHED + 1 has; and a passage that covers a place not yet covered shares a shingle there, gaps apart (`rarest`). `needed`
goes by length, begin and end of what may be a passage, and by shingles that nobody else has. Spots are compared
with the first one that has such a shingle, and then, where places stay open, with all earlier ones that have one: these lie
with the homes of the shingles that are asked for (a shingle's home is the first spot that has it), in parts where a home has many,
and a spot with open places goes to the homes of its keys, so that what is sent grows with the spots. There `Block` finds and compares
its pairs, each in the smallest home that it shares keys in. No value is cut off, and no pair is a row; but the comparisons grow with
the square of different spots where places stay open that share such shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text import INVERSE, ODD, SPACED, Words, buffers, map_slices, mix, powers, release, small_batches, text_udf, unused

SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
#: Shingles of the shortest passage, and of the context on one side of a window's smallest shingle.
LEAST = PASSAGE - SHINGLE + 1
HALF = LEAST // 2
#: Hash functions (two bits of a value name the function), and how many must agree.
HASHES, ENOUGH = 4, 2
#: How far places of a pair may move against each other inside one stretch; stretches begin and end at multiples of SNAP.
DRIFT, SNAP = 16, 32
#: Pairs of places compared at once, and shingles by which parts of a long document overlap then.
PAIRS, OVERLAP = 1 << 18, 8 * LEAST
#: Windows of a value all of which are tied to each other, and words of each half of a run (`Runs`).
FEW, PART = 16, PASSAGE // 2
#: The bit of runs that lie in no verified passage (`Runs`, which `repeats` no longer uses; its test is kept).
ASKS = 256
#: (bit, kind, first, end): the edits that runs may have which agree otherwise, by the part that they agree in.
_M, _K = PART + PART // 2 + 1, PART // 2
EDITS = [(1, 1, _M, PASSAGE), (1, 2, _M, PASSAGE + 1), (2, 1, PART, _M), (4, 2, PART, _M), (8, 1, 0, _K), (16, 1, _K, PART), (32, 2, 0, _K + 1), (64, 2, _K + 1, PART + 1)]
#: Of up to 2 LEAST - 1 shingles at most a fifth is without a match in a similar passage, so LEAST in a row have as many as this with one.
MATCHED = LEAST - (2 * LEAST - 1) // 5
#: Shingles of stretches compared at once (one longer pair is compared alone).
COMPARED = 1 << 17
#: Shingles of the spots of a block, and least of them where there are under EVEN blocks of a home; matches looked through at once.
BLOCK, LITTLE, EVEN, LOOKED = 1 << 19, 1 << 16, 16, 1 << 21
#: Links of spots that are handed on together.
HANDED = 1 << 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _block_max(values: np.ndarray, width: int) -> np.ndarray:
    """Largest of values[i : i + width] for each i where that lies inside."""
    n = len(values)
    padded = np.zeros(-(-n // width) * width, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.maximum.accumulate(blocks, axis=1).ravel()
    return np.maximum(ahead[: n - width + 1], behind[width - 1 : n])


def smallest_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some run of ``width`` values (uint64)."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = ~_block_max(~values, width)
    edge = np.zeros(width - 1, values.dtype)
    return np.flatnonzero(values == _block_max(np.concatenate([edge, least, edge]), width))


def extents(at: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, l, r): the places up to which each candidate is smallest inside its text [first, last].

    Both neighbours that bound a candidate are smallest in longer runs, so they are candidates themselves. Of equal
    values less than HALF apart one is kept.
    """
    n = len(at)
    text = np.cumsum(np.diff(first, prepend=-1) != 0)
    before, behind = np.arange(n) - 1, np.arange(n) + 1  # the nearest that is not larger, and that is smaller
    before[np.diff(text, prepend=0) != 0] = -1
    behind[np.diff(text, append=-1) != 0] = -1
    for nearest, passed in ((before, np.greater), (behind, np.greater_equal)):
        live = np.flatnonzero(nearest >= 0)
        while len(live):  # past what is larger by way of its own neighbour
            live = live[passed(values[nearest[live]], values[live])]
            nearest[live] = nearest[nearest[live]]
            live = live[nearest[live] >= 0]
    left, right = np.where(before >= 0, at[before] + 1, first), np.where(behind >= 0, at[behind] - 1, last)
    kept, tie = np.ones(n, bool), {}
    for i in np.flatnonzero((before >= 0) & (values[before] == values)).tolist():  # tie: the last place kept of the value
        c, p = int(at[i]), int(before[i])
        held = tie.get(p, int(at[p]))
        kept[i] = c - held >= HALF
        tie[i] = c if kept[i] else held
    return kept, left, right


def _windows_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, value, c, l, r, ctx) of all compact windows of the texts, for all hash functions.

    ctx packs hashes of the words before and behind c (0: the text ends there).
    """
    data, offsets = buffers(column)
    words = Words(data, offsets, SPACED)
    shingle, whole = words.shingles(SHINGLE)
    n = len(shingle)
    base = words.first[:-1][words.doc] if n else np.zeros(0, np.int64)
    final = (words.first[1:][words.doc] - SHINGLE) if n else base
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * powers(ODD, n)[:n], out=sums[1:])
    inverse = powers(INVERSE, n)
    span = HALF + SHINGLE - 1

    def context(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        a = np.where(inside, a, 0)
        got = mix((sums[np.minimum(a + span, n)] - sums[a]) * inverse[a]) >> np.uint64(32)
        return np.where(inside, np.maximum(got, 1), 0).astype(np.uint64)

    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for f in range(HASHES):
        value = (mix(shingle + np.uint64(f + 1) * mix(np.array([f + 1], np.uint64))) | np.uint64(3)) - np.uint64(3 - f)
        value[~whole] = 0  # no text goes on across here
        c = smallest_of_runs(value, LEAST)
        c = c[whole[c]]
        kept, left, right = extents(c, value[c], base[c], final[c])
        c, left, right = c[kept], left[kept], right[kept]
        before, behind = context(c - HALF + 1, c - HALF + 1 >= base[c]), context(c, c + HALF - 1 <= final[c])
        at = base[c]
        for held, x in zip(out, (words.doc[c], value[c].view(np.int64), c - at, left - at, right - at, (before << np.uint64(32) | behind).view(np.int64))):
            held.append(x)
    return tuple(np.concatenate(x) for x in out)


def windows(docs: DataFrame) -> DataFrame:
    """(value, doc, c, l, r, ctx) of all windows of documents with an id."""
    names, kinds = ["value", "doc", "c", "l", "r", "ctx"], [np.int64, np.int64, np.int32, np.int32, np.int32, np.int64]

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            row, value, *place, ctx = _windows_of(b.column(1))
            doc = b.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip((value, doc, *place, ctx), kinds)], names)

        return part

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, "text", make, "value long, doc long, c int, l int, r int, ctx long")


def joined_ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [start, end), in order, overlapping and touching ones joined."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    starts, reached = starts[by], np.maximum.accumulate(ends[by])
    cut = np.flatnonzero(starts[1:] > reached[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), reached[np.concatenate([cut - 1, [-1]])].tolist()))


class Runs:
    """Hashes of parts of the runs that begin at ``at``; an edit is a word that is left out."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.n, self.at = len(words), at
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * powers(ODD, self.n)[: self.n], out=self.sums[1:])
        self.inverse = powers(INVERSE, self.n + PASSAGE)

    def part(self, first, end, which: np.ndarray, shift: int = 0) -> np.ndarray:
        """Words [first, end) of the runs, as if they began ``shift`` words earlier."""
        s = self.at[which]
        return (self.sums[s + end] - self.sums[s + first]) * self.inverse[s + shift]

    def coarse(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, which, bit): runs with an edit alike agree in the shared half and in one part of the other half too.

        ``halves``: see ``shared_halves``; ASKS may be added, and is then added to the bits. bit: the EDITS that the
        part leaves open, 128 for a run without an edit beside one with a word more.
        """
        m, k = _M, _K
        out = []

        def add(tag: int, bit: int, which: np.ndarray, *parts: tuple[int, ...]):
            key = sum((self.part(*x[:2], which, *x[2:]) for x in parts), np.zeros(len(which), np.uint64))
            out.append((mix(key + np.array([tag], np.uint64) * INVERSE), which, bit + (halves[which] & ASKS)))

        fits = self.at + PASSAGE < self.n
        head, tail, longer = (np.flatnonzero(x) for x in (halves & 1 > 0, halves & 2 > 0, (halves & 4 > 0) & fits))
        also = np.flatnonzero((halves & 1 > 0) & fits)
        add(1, 1, head, (0, m))
        add(2, 2, head, (0, PART), (m, PASSAGE))
        add(3, 4, also, (0, PART), (m, PASSAGE + 1, 1))
        add(3, 128, head, (0, PART), (m - 1, PASSAGE))
        add(4, 8, tail, (k, PASSAGE))
        add(4, 32, longer, (k + 1, PASSAGE + 1, 1))
        add(5, 16, tail, (0, k), (PART, PASSAGE))
        add(6, 64, longer, (0, k + 1), (PART + 1, PASSAGE + 1, 1))
        add(6, 128, tail, (0, k + 1), (PART, PASSAGE))
        key, which, bit = (np.concatenate(x) for x in zip(*out))
        return key.view(np.int64), which, bit

    def keys(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, which, edit, kind) of the runs; ``bits``: those of ``coarse`` that another run shares.

        Kinds 0: PASSAGE words, edit -1; 1: the same but for the word at place + edit; 2: PASSAGE + 1 words but for that one.
        A run of kind 0 and one of kind 2 with one key differ by one word more; keys of kind 1 agree with none of another kind.
        """
        every = np.arange(len(self.at))
        out = [(mix(self.part(0, PASSAGE, every)), every, np.full(len(every), -1), np.zeros(len(every), np.int64))]
        for bit, kind, first, end in EDITS:
            size = PASSAGE + kind - 1
            which = np.flatnonzero((bits & bit > 0) & (self.at + size <= self.n))
            edit = np.tile(np.arange(first, end), len(which))
            which = np.repeat(which, end - first)
            key = self.part(0, edit, which) + self.part(edit + 1, size, which, 1)
            if kind == 1:
                key = mix(key + (edit + 1).astype(np.uint64) * INVERSE)
            out.append((mix(key), which, edit, np.full(len(which), kind)))
        key, which, edit, kind = (np.concatenate(x) for x in zip(*out))
        return key.view(np.int64), which, edit, kind


def rarest(place: np.ndarray, shingle: np.ndarray, n: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Which of the given shingles: a similar passage that covers open places of a spot has one of them at least.

    ``place``, ``shingle`` and ``n``: those that an earlier spot has too, and how many have them. Of LEAST in a row MATCHED must
    be such; without the rarest LEAST - MATCHED + 1 (those that none has are rarest) fewer are left. As a passage begins and ends
    with a match, it has a match at an open place too, but where open places are a gap that holds no match; the rarer set is taken.
    """
    m = len(opens)
    rank, times, held = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, -1)
    by = np.lexsort((shingle, n))
    rank[place[by]], times[place], held[place] = np.arange(1, len(by) + 1), n, np.arange(len(place))
    closed = np.flatnonzero(~opens)
    narrow = np.flatnonzero((np.diff(closed) > 1) & (np.diff(closed) <= LEAST - MATCHED + 1))
    gap = np.zeros(m, bool)
    for i in narrow.tolist():
        gap[closed[i] + 1 : closed[i + 1]] = True
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, LEAST)
    own = opens & (rank > 0)
    asks = (view(own).any(axis=1) | view(gap).any(axis=1)) & (np.count_nonzero(view(rank), axis=1) >= MATCHED)
    if not asks.any():
        return by[:0]
    first = np.partition(view(rank)[asks], LEAST - MATCHED, axis=1)[:, : LEAST - MATCHED + 1]
    cost = np.where(first > 0, n[by][first - 1], 0).sum(axis=1)
    plain = ~view(gap)[asks].any(axis=1) & (np.where(own, times, 0)[np.flatnonzero(asks)[:, None] + np.arange(LEAST)].sum(axis=1) < cost)
    chosen = np.unique(first[~plain])
    spots = np.zeros(m, bool)
    for i in np.flatnonzero(asks)[plain].tolist():
        spots[i : i + LEAST] = True
    return np.unique(np.concatenate([by[chosen[chosen > 0] - 1], held[spots & own]]))


def needed(place: np.ndarray, n: np.ndarray, spot: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Which of the given shingles: a similar passage of any length that covers open places of a spot has one of them at least.

    ``place`` and ``n``: places of the shingles of the ``spot`` that an earlier spot has too, and how many have them. A passage of m
    different shingles begins and ends with a match and has at most m / 5 without one. Open places that no such stretch of shared
    shingles holds ask nothing. Around others the rarest shingles of each run are taken, one more than may lack a match besides those
    that nobody else has. Where no gap of open places can lie between matches, those at open places serve as well; the rarer set is
    taken. Runs of a few sizes do for all passages, as any holds one that is a little shorter.
    """
    m = len(opens)
    times = np.zeros(m, np.int64)
    times[place] = n
    shared = times > 0
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    value = np.unique(spot, return_inverse=True)[1]
    by = np.argsort(value, kind="stable")
    before = np.full(m, -1)  # the same shingle's place before
    same = np.flatnonzero(np.diff(value[by]) == 0)
    before[by[same + 1]] = by[same]
    # the longest stretch from each match to another with four of five shared (repeats of what nobody shares count nothing)
    total = sums(np.where(shared, 1, np.where(before < 0, -4, 0)))
    starts = np.flatnonzero(shared)
    reach = np.searchsorted(-np.maximum.accumulate(total[::-1])[::-1], -total[starts], "right") - 1
    end = np.maximum.accumulate(np.where(shared, np.arange(m), -1))[np.maximum(reach - 1, 0)] + 1
    far = end - starts >= LEAST
    if not far.any():
        return place[:0]
    starts, end = starts[far], end[far]
    able = np.cumsum(np.bincount(starts, minlength=m + 1) - np.bincount(end, minlength=m + 1))[:m] > 0
    own = opens & shared & able
    if not (opens & able).any():
        return place[:0]
    longest = int((end - starts).max())
    rank, ranked = np.full(m, m), np.lexsort((value, times))
    ranked = ranked[shared[ranked]]
    rank[ranked] = np.arange(len(ranked))
    cost_of = np.append(times[ranked], 0)
    edges = np.concatenate([[-1 << 40], np.flatnonzero(~opens), [1 << 40]])
    width = np.diff(edges)[np.searchsorted(edges, np.arange(m), "right") - 1] - 1  # of the stretch of open places
    alone, held_times, view = sums(~shared), sums(np.where(own, times, 0)), np.lib.stride_tricks.sliding_window_view
    chosen, serving, around = np.zeros(m + 1, bool), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)

    sizes, long = [(LEAST, 1, 4 - LEAST % 5)], LEAST + 5 - LEAST % 5
    while long <= longest:
        step = 1 if long < 2 * LEAST else long // 16
        more = long + (5 if step == 1 else step)
        sizes.append((long, step, more + (1 if more < 2 * LEAST else more // 16) - 2 - long))
        long = more
    for size, step, slack in sizes:
        gap = opens & able & (width <= (size + slack) // 5)
        at = np.arange(0, m - size + 1, step)
        low, high = np.maximum(at - slack, 0), np.minimum(at + size + slack, m)
        wanted = sums(own | gap)
        some = wanted[high] > wanted[low]
        if len(same) == 0:
            left = size + slack - 5 * (alone[at + size] - alone[at])
            some &= left >= 0
            left = left[some]
        at, low, high = at[some], low[some], high[some]
        gaps, bound = sums(gap), max(1, (1 << 21) // size)
        for k in range(0, len(at), bound):
            a, lo, hi = at[k : k + bound], low[k : k + bound], high[k : k + bound]
            order = view(rank, size)[a]
            if len(same):
                first = view(before, size)[a] < a[:, None]
                left_of = first.sum(axis=1) + slack - 5 * (first & ~view(shared, size)[a]).sum(axis=1)
                fits = left_of >= 0
                a, lo, hi, left_of = a[fits], lo[fits], hi[fits], left_of[fits]
                order = np.where(first[fits], order[fits], m)
                if not len(a):
                    continue
            else:
                left_of = left[k : k + bound]
            lacking = left_of // 5
            most = min(int(lacking.max()), size - 1)
            order = np.sort(np.partition(order, most, axis=1)[:, : most + 1], axis=1)
            order = np.where(np.arange(most + 1) <= lacking[:, None], order, m)
            cost = cost_of[np.minimum(order, len(ranked))].sum(axis=1)
            plain = (gaps[hi] == gaps[lo]) & (held_times[hi] - held_times[lo] < cost)
            few = ~plain & ((order < m).sum(axis=1) <= lacking)  # the match may stand beside the run
            chosen[order[~plain]] = True
            for taken, these in ((serving, plain), (around, few)):
                np.add.at(taken, lo[these], 1)
                np.add.at(taken, hi[these], -1)
    which = (np.cumsum(serving[:m]) > 0) & own | (np.cumsum(around[:m]) > 0) & shared
    which[ranked[chosen[: len(ranked)]]] = True
    return np.flatnonzero(which[place])


def _places(lists: pa.ListArray) -> np.ndarray:
    """Rows c, l and r of all structs of the lists."""
    flat = lists.flatten()
    return np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("c", "l", "r")])


def tied_places(pos: pa.ListArray, rpos: pa.ListArray, hash_fn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, rplaces, hash_fn) of every place of a value in one document with every place of it in the other.

    At most about PAIRS at once: in parts that follow the first document and overlap by several passages.
    """
    count, rcount = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pos, rpos))
    own, other = _places(pos), _places(rpos)
    value = np.repeat(np.arange(len(count)), count)
    by = np.argsort(own[0], kind="stable")
    own, value = own[:, by], value[by]
    begin = np.cumsum(rcount) - rcount
    total = np.cumsum(rcount[value])
    at, size = 0, own.shape[1]
    while at < size:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        held = value[at:end]
        n = rcount[held]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(own[:, at:end], n, axis=1), other[:, np.repeat(begin[held], n) + within], np.repeat(hash_fn[held], n)
        back = int(np.searchsorted(own[0], own[0, end] - OVERLAP)) if end < size else end
        at = max(back, at + (end - at + 1) // 2)


def stretches(row: np.ndarray, own: np.ndarray, other: np.ndarray, hash_fn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, a, b, ra, rb), in shingles, of both texts of each row: where tied windows (c, l, r) of ENOUGH hash functions overlap."""
    (c, low, high), (rc, rlow, rhigh) = own, other
    begin, end, move = c - np.minimum(c - low, rc - rlow), c + np.minimum(high - c, rhigh - rc), c - rc
    by = np.lexsort((move, row))
    # windows of a row whose places move alike
    new = (np.diff(row[by], prepend=-1) != 0) | (np.diff(move[by], prepend=0) > DRIFT)
    group = np.empty(len(row), np.int64)
    group[by] = np.cumsum(new)
    by = np.lexsort((begin, group))
    row, begin, end, move, bit, group = row[by], begin[by], end[by], move[by], 1 << hash_fn[by].astype(np.int64), group[by]
    most = int(end.max(initial=0)) + 1
    reached = np.maximum.accumulate(end + group * most) - group * most  # by the windows before, inside the group
    cut = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (begin > np.concatenate([[-1], reached[:-1]])))
    if not len(cut):
        return (np.zeros(0, np.int64),) * 5
    ends = np.append(cut[1:], len(row)) - 1
    agreed = np.bitwise_count(np.bitwise_or.reduceat(bit, cut)) >= ENOUGH
    a, b = begin[cut] - HALF, reached[ends] + HALF + 1
    ra, rb = a - np.maximum.reduceat(move, cut), b - np.minimum.reduceat(move, cut)
    down, up = (lambda x: np.maximum(x // SNAP * SNAP, 0)), (lambda x: -(-x // SNAP) * SNAP)
    return tuple(x[agreed] for x in (row[cut], down(a), up(b), down(ra), up(rb)))


def chained(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc, a, b, rdoc, ra, rb) of the stretches of rows (doc, rdoc, lists of pos, rpos and hash function of each shared value)."""
    lists = batch.column(2)
    values = lists.flatten()
    pos, rpos, f = values.field("pos"), values.field("rpos"), values.field("f").to_numpy(zero_copy_only=False)
    count, rcount = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pos, rpos))
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    row_of = np.repeat(np.arange(len(n)), n)
    work = np.bincount(row_of, count * rcount, len(n))
    found: list[tuple[np.ndarray, ...]] = []
    sums, at = np.cumsum(work), 0
    while at < len(n):  # rows together, as long as they have few pairs of places; a row with more in parts
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        part, size = slice(int(first[at]), int(first[end - 1] + n[end - 1])), int(n[at:end].sum())
        held, rheld, of = pos.slice(part.start, size), rpos.slice(part.start, size), f[part]
        if end == at + 1:
            for own, other, fn in tied_places(held, rheld, of):
                found.append(stretches(np.full(len(fn), at), own, other, fn))
        else:
            own, other = _places(held), _places(rheld)
            c, rc = count[part], rcount[part]
            of_value = np.repeat(np.arange(size), c)
            times = rc[of_value]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            value = np.repeat(of_value, times)
            begin = np.cumsum(rc) - rc
            found.append(stretches(row_of[part][value], np.repeat(own, times, axis=1), other[:, begin[value] + within], of[value]))
        at = end
    row, *spans = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
    which = np.unique(np.stack([row, *spans]), axis=1) if len(row) else np.zeros((5, 0), np.int64)
    ids = [batch.column(i).take(pa.array(which[0])) for i in (0, 1)]
    a, b, ra, rb = (pa.array(x.astype(np.int32)) for x in which[1:])
    return pa.RecordBatch.from_arrays([ids[0], a, b, ids[1], ra, rb], ["doc", "a", "b", "rdoc", "ra", "rb"])


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, end), one after another."""
    n = end - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _nearest(places: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Of each range [low, high) of the places, in order there, the one nearest to the wanted place."""
    lo, hi = low, high
    while (lo < hi).any():  # the first that stands at the wanted place or behind it
        mid = (lo + hi) // 2
        less = (lo < hi) & (places[np.minimum(mid, len(places) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    right, left = places[np.minimum(lo, high - 1)], places[np.maximum(lo - 1, low)]
    return np.where(np.abs(left - want) <= np.abs(right - want), left, right)


def _moves(row: np.ndarray, shift: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``move`` with the median shift of each row (in order) that has one."""
    order = np.lexsort((shift, row))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    move[row[first]] = shift[order][first + (np.diff(first, append=len(row)) - 1) // 2]
    return move


def _matched(px: np.ndarray, x: np.ndarray, py: np.ndarray, y: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of x the place of an equal one of its pair in y, -1 without any; and the places before of the same in x and in y.

    Of several that nearest to where the pair's unique ones lie (``move``: how far apart where it has none).
    """
    n, total = len(x), len(x) + len(y)
    key = np.concatenate([px << 32 | x, py << 32 | y])
    bits, most = total.bit_length(), max(int(px[-1]) if n else 0, int(py[-1]) if len(y) else 0)
    if most.bit_length() + 32 + bits < 64:  # places go along in the low bits
        packed = np.sort(key << bits | np.arange(total))
        at, key = packed & ((1 << bits) - 1), packed >> bits
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    theirs, same = at >= n, np.zeros(total, bool)
    same[1:] = key[1:] == key[:-1]
    again = np.flatnonzero(same[1:] & (theirs[1:] == theirs[:-1])) + 1
    earlier = np.full(total, -1)
    earlier[at[again]] = at[again - 1]
    earlier[n:] = np.where(earlier[n:] >= 0, earlier[n:] - n, -1)
    start = np.flatnonzero(~same)
    end = np.append(start[1:], total)[: len(start)]
    held = np.concatenate([[0], np.cumsum(theirs)])
    low = end - (held[end] - held[start])  # those of y stand behind those of x
    group = np.cumsum(~same) - 1
    mine = np.flatnonzero(~theirs)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[at[mine]], last[at[mine]] = low[group[mine]], end[group[mine]]
    places = at - n
    place = np.full(n, -1)
    alone, several = np.flatnonzero(last - first == 1), np.flatnonzero(last - first > 1)
    place[alone] = places[first[alone]]
    if len(several):
        move = _moves(px[alone], alone - place[alone], move)
        place[several] = _nearest(places, first[several], last[several], several - move[px[several]])
    return place, earlier[:n], earlier[n:]


def _over(f: np.ufunc, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return f.reduceat(values, np.stack([low, high], axis=1).ravel())[::2]


def _fresh(earlier: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """How many of the places [low, high) (of those that ``at`` names) have no same one before them from ``least`` on."""
    places = _ranges(low, high)
    fresh = np.append(earlier[places if at is None else at[places]] < np.repeat(least, high - low), False)
    return np.add.reduceat(fresh, np.cumsum(high - low) - (high - low), dtype=np.int64)  # no range is empty


def _similar(row: np.ndarray, hx: np.ndarray, hy: np.ndarray, earlier_x: np.ndarray, earlier_y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, similarity) of runs of shingles of x that are near-duplicates of runs of y, for all pairs (rows, in order) of both.

    hx, hy: places of matches; earlier: the places before of the same shingle. The runs from the first to the last match are compared
    for all pairs at once; those that are not similar enough are cut at their widest gap in either text, and the parts are compared
    in the next round.
    """
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    gap = np.append(np.maximum(np.diff(hx), np.abs(np.diff(hy))), 0)
    padded = np.append(hy, hy[-1:])
    again_x, again_y = (np.concatenate([[0], np.cumsum(e >= 0)]) for e in (earlier_x, earlier_y))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    end = np.append(first[1:], len(row))[: len(first)]
    while True:
        a, b = hx[first], hx[end - 1] + 1
        # where no shingle stands twice, a similar run of LEAST or more has four of five as matches
        long = (b - a >= LEAST) & ((end - first >= SIMILAR * LEAST) | (again_x[b] > again_x[a]))
        first, end, a, b = first[long], end[long], a[long], b[long]
        if not len(first):
            break
        low, high = _over(np.minimum, padded, first, end), _over(np.maximum, padded, first, end) + 1
        both, mine, theirs = end - first, b - a, high - low
        odd = np.flatnonzero(again_x[b] > again_x[a])
        if len(odd):
            mine[odd] = _fresh(earlier_x, a[odd], b[odd], a[odd])
            both[odd] = _fresh(earlier_x, first[odd], end[odd], a[odd], hx)
        odd = np.flatnonzero(again_y[high] > again_y[low])
        if len(odd):
            theirs[odd] = _fresh(earlier_y, low[odd], high[odd], low[odd])
        similarity = both / (mine + theirs - both)
        good = similarity >= SIMILAR
        out.append((row[first[good]], a[good], b[good], similarity[good]))
        first, end = first[~good], end[~good]
        if not len(first):
            break
        n = end - first - 1
        gaps, run = _ranges(first, end - 1), np.repeat(np.arange(len(n)), n)
        widest = np.maximum.reduceat(gap[gaps], np.cumsum(n) - n)
        at = np.flatnonzero(gap[gaps] == widest[run])
        cut = gaps[at[np.diff(run[at], prepend=-1) != 0]] + 1
        cut = np.where(widest > 1, cut, (first + end) // 2)
        first, end = np.stack([first, cut], axis=1).ravel(), np.stack([cut, end], axis=1).ravel()
    return tuple(np.concatenate(x) for x in zip(*out))


def _passages(xs: pa.ListArray, ys: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nx, ny = (v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for v in (xs, ys))
    px, py = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    x0, y0 = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF for v in (xs, ys))
    place, earlier_x, earlier_y = _matched(px, x, py, y, x0 - y0)
    hit = np.flatnonzero(place >= 0)
    row, a, b, similarity = _similar(px[hit], hit, place[hit], earlier_x, earlier_y)
    return row, a - x0[row], b - x0[row], similarity


def passages(xs: pa.ListArray, ys: pa.ListArray) -> list[tuple[int, int, int, float]]:
    """(pair, start, end, similarity) of runs of shingles of each x that are near-duplicates of runs of its y (`_similar`)."""
    return list(zip(*(v.tolist() for v in _passages(xs, ys))))


def coupled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rdoc, pos, rpos, f) of all pairs of windows of a value in two documents; rows are a value and the list of its windows."""
    for batch in batches:
        lists = batch.column(1)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        f = np.repeat(batch.column(0).to_numpy(zero_copy_only=False) & 3, n)
        times = np.repeat(n, n)
        own = np.repeat(np.arange(len(flat)), times)
        other = _ranges(np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n), n))
        doc = flat.field("doc").to_numpy(zero_copy_only=False)
        later = doc[other] < doc[own]
        own, other = own[later], other[later]
        spot = pa.StructArray.from_arrays([flat.field(k) for k in ("c", "l", "r")], ["c", "l", "r"])
        each = pa.array(np.arange(len(own) + 1, dtype=np.int32))
        columns = [pa.array(doc[own]), pa.array(doc[other]), *(pa.ListArray.from_arrays(each, spot.take(pa.array(x))) for x in (own, other)), pa.array(f[own])]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "rdoc", "pos", "rpos", "f"])
    release()


def alike_lists(xs: pa.ListArray, ys: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, start, end, similarity) as `passages` gives them, COMPARED shingles at once."""
    size = np.cumsum(xs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + ys.value_lengths().to_numpy(zero_copy_only=False))
    at = 0
    while at < len(xs):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + COMPARED, "right")))
        which, s, e, j = _passages(xs.slice(at, end - at), ys.slice(at, end - at))
        if len(which):
            yield which + at, s, e, j
        at = end


class Block:
    """Spots (their documents and lists of shingles) that others are compared with."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, lists: pa.ListArray):
        self.h, self.doc, self.lists = h, doc, lists
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.begin = np.cumsum(n) - n
        by = np.argsort(flat, kind="stable")
        owner, shingle = np.repeat(np.arange(len(n)), n)[by], flat[by]
        self.place = by - self.begin[owner]
        # an entry is a shingle of a spot; its places lie together, in order
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(shingle) != 0) | (np.diff(owner) != 0)
        self.first = np.flatnonzero(new)
        self.n = np.diff(self.first, append=len(by))
        self.shingle, self.owner = shingle[self.first], owner[self.first]
        self.earlier = np.full(len(by), -1)  # the same shingle's place before in its spot, all spots in a row
        again = np.flatnonzero(~new)
        self.earlier[by[again]] = by[again - 1]

    def _entries(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.searchsorted(self.shingle, shingles, side) for side in ("left", "right"))
        return np.repeat(np.arange(len(low)), high - low), _ranges(low, high)

    def holders(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, spot): all spots of each shingle."""
        which, entry = self._entries(shingles)
        return which, self.owner[entry]

    def candidates(self, doc: int, keys: np.ndarray, early: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Spots of earlier documents that have one of the keys, but none that is ``early``, and are not ``done``."""
        found = np.zeros(len(self.h), bool)
        found[self.holders(keys)[1]] = True
        found[self.holders(early)[1]] = False
        found = np.flatnonzero(found)
        return found[(self.doc[found] < doc) & ~np.isin(self.h[found], done)]

    def _hits(self, spot: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, place, other place) of the matches of a spot with each of ``found``, as `_matched` pairs them; None: more than LOOKED."""
        low, high = (np.searchsorted(self.shingle, spot, side) for side in ("left", "right"))
        if (high - low).sum() > LOOKED:
            return None
        number = np.full(len(self.h), -1, np.int32)
        number[found] = np.arange(len(found))
        entry = _ranges(low, high)
        row, x = number[self.owner[entry]], np.repeat(np.arange(len(spot)), high - low)
        held = np.flatnonzero(row >= 0)
        by = held[np.argsort(row[held].astype(np.uint16) if len(found) < 1 << 16 else row[held], kind="stable")]
        row, x, entry = row[by].astype(np.int64), x[by], entry[by]
        place = self.place[self.first[entry]]
        several = self.n[entry] > 1
        if several.any():
            alone, several = np.flatnonzero(~several), np.flatnonzero(several)
            move = _moves(row[alone], x[alone] - place[alone], np.zeros(len(found), np.int64))
            low = self.first[entry[several]]
            place[several] = _nearest(self.place, low, low + self.n[entry[several]], x[several] - move[row[several]])
        return row, x, place

    def alike(self, spot: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(spot of the block, start, end, similarity) of what `passages` finds in a spot and each of ``found``; no pair is sorted anew."""
        nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        if not len(found) or len(spot) < LEAST:
            return nothing
        hits = self._hits(spot, found)
        if hits is None:
            out, own = [nothing], pa.ListArray.from_arrays(pa.array([0, len(spot)], pa.int32()), pa.array(spot))
            for k in found.tolist():
                out += [(np.full(len(s), k), s, e, j) for _, s, e, j in alike_lists(own, self.lists.slice(k, 1))]
            return tuple(np.concatenate(x) for x in zip(*out))
        row, x, place = hits
        by = np.argsort(spot, kind="stable")
        same = np.flatnonzero(np.diff(spot[by]) == 0)
        earlier = np.full(len(spot), -1)
        earlier[by[same + 1]] = by[same]
        row, s, e, j = _similar(row, x, self.begin[found[row]] + place, earlier, self.earlier)
        return found[row], s, e, j

    def partners(self, doc: int, spot: np.ndarray, keys: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Spots of earlier documents that have one of the keys, but for those ``done`` and those that can hold no similar passage.

        A passage of LEAST shingles or more has a match at four of five that differ, so a stretch as long has where matches count 1,
        others -4 and their repeats nothing.
        """
        found = np.unique(self.holders(keys)[1])
        found = found[(self.doc[found] < doc) & ~np.isin(self.h[found], done)]
        m = len(spot)
        if not len(found) or m < LEAST:
            return found[:0]
        first = np.zeros(m, bool)
        first[np.unique(spot, return_index=True)[1]] = True
        lacks = np.where(first, -4, 0).astype(np.int32)
        place, of = self.holders(spot)
        number = np.full(len(self.h), -1)
        number[found] = np.arange(len(found))
        row = number[of]
        place, row = place[row >= 0], row[row >= 0]
        by = np.argsort(row, kind="stable")
        place, row = place[by], row[by]
        fits, step = np.zeros(len(found), bool), max(1, LOOKED // m)
        for at in range(0, len(found), step):
            end = min(at + step, len(found))
            gain = np.tile(lacks, (end - at, 1))
            these = slice(*np.searchsorted(row, [at, end]))
            gain[row[these] - at, place[these]] = 1
            total = np.zeros((end - at, m + 1), np.int32)
            np.cumsum(gain, axis=1, out=total[:, 1:])
            fits[at:end] = (total[:, LEAST:] >= np.minimum.accumulate(total[:, : m - LEAST + 1], axis=1)).any(axis=1)
        return found[fits]


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, start, end, of_doc, similarity): words [start, end) repeat a passage of an earlier document.

    Passages have PASSAGE words or more; of_doc < doc_id. Documents with a null id or text take no part; rows
    that repeat an id are one document in several texts, told apart by text_hash = xxhash64(text). Texts
    shorter than a passage, and empty tables, give no rows. Other columns take no part.
    """
    return repeated(docs, scratch).select("doc_id", "text_hash", "start", "end", F.inline("links"))


def repeated(docs: DataFrame, scratch: Scratch | None = None, links: bool = True) -> DataFrame:
    """(doc_id, text_hash, start, end, links): the stretches of `repeats`; links: (of_doc, similarity) of each earlier document, once.

    Without ``links`` all that is told is which words lie in such stretches; these may come joined or in several rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    every = scratch.save(windows(docs))
    seen = every.groupBy("value").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count("*").alias("n"))
    shared = scratch.save(seen.where("d0 < d1").select("value", "d0", (F.col("n") <= FEW).alias("few")))
    # joins by shuffle throughout: what they join grows with the corpus; where one side has a key once, the other need not be sorted
    tied = scratch.save(every.join(shared.hint("shuffle_hash"), "value"))
    scratch.drop(every)
    listed = tied.where("few").groupBy("value").agg(F.collect_list(F.struct("doc", "c", "l", "r")).alias("w"))
    place_list = "array<struct<c: int, l: int, r: int>>"
    close = listed.mapInArrow(coupled, f"doc long, rdoc long, pos {place_list}, rpos {place_list}, f long")
    sides = {"before": F.shiftright("ctx", 32), "behind": F.col("ctx").bitwiseAND(F.lit(0xFFFFFFFF))}
    tied_on = tied.where("not few").withColumns(sides).drop("ctx", "few")
    near, small = tied_on, []
    for side, to in (("before", "d2"), ("behind", "d3")):
        least = tied_on.where(f"{side} <> 0").groupBy("value", side).agg(F.min("doc").alias(to), F.max("doc").alias("most"))
        small.append(scratch.save(least.where(f"{to} < most").drop("most")))  # written, so that skewed keys of the join can be split
        near = near.join(small[-1].hint("merge"), ["value", side], "left")
    near = scratch.save(near.drop("before", "behind"))
    scratch.drop(shared, *small)
    targets = F.array_distinct(F.array_compact(F.array("d0", "d2", "d3")))
    place = F.struct("c", "l", "r")
    asked = near.select("value", "doc", "c", "l", "r", F.explode(targets).alias("rdoc")).where("rdoc < doc").groupBy("value", "doc", "rdoc").agg(F.collect_list(place).alias("pos"))
    # all places of a value in a target, beside all in the document: as many numbers as places, not as pairs of them
    first = scratch.save(near.where("doc = d0 or doc = d2 or doc = d3").groupBy("value", F.col("doc").alias("rdoc")).agg(F.collect_list(place).alias("rpos")))
    far = asked.join(first.hint("merge"), ["value", "rdoc"]).select("doc", "rdoc", "pos", "rpos", F.col("value").bitwiseAND(F.lit(3)).alias("f"))
    pairs = close.union(far).groupBy("doc", "rdoc").agg(F.collect_list(F.struct("pos", "rpos", "f")).alias("w"))

    def chain(batches):
        for batch in batches:
            yield chained(batch)
        release()

    found = scratch.save(pairs.mapInArrow(chain, "doc long, a int, b int, rdoc long, ra int, rb int"))

    scratch.drop(tied, first)
    wanted = found.select("doc", "a", "b").union(found.select("rdoc", "ra", "rb")).distinct()
    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("w"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(listed.hint("shuffle_hash"), "doc").where("text is not null")

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(*buffers(b.column(1)), SPACED)
            shingle = (words.shingles(SHINGLE)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            n = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            begin, end = (b.column(3).flatten().field(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
            low = words.first[:-1][row]
            high = np.maximum(low, words.first[1:][row] - SHINGLE + 1)
            parts = [shingle[s:e] for s, e in zip(np.minimum(low + begin, high).tolist(), np.minimum(low + end, high).tolist())]
            hashes = [xxhash.xxh64_intdigest(p.tobytes()) - (1 << 63) for p in parts]
            taken = pa.array(row)
            return pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(2).take(taken), pa.array(begin), pa.array(end), pa.array(hashes, pa.int64()), _lists(parts, np.int32)], ["doc", "th", "a", "b", "h", "sh"])

        return part

    read = scratch.save(map_slices(texts.select("doc", "text", F.xxhash64("text").alias("th"), "w"), "text", make, "doc long, th long, a int, b int, h long, sh array<int>"))
    # pairs of distinct stretches, known by hashes of their shingles, are compared once
    whose = read.select("doc", "th", "a", "b", "h")
    theirs = whose.select(F.col("doc").alias("rdoc"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("h").alias("rh")).distinct()
    linked = found.join(whose.hint("merge"), ["doc", "a", "b"]).join(theirs.hint("merge"), ["rdoc", "ra", "rb"])
    linked = scratch.save(linked.select("doc", "th", "a", "rdoc", "h", "rh"))
    contents = scratch.save(read.select("h", "sh").dropDuplicates(["h"]))
    pair = linked.select("h", "rh").distinct().join(contents.hint("merge"), "h").join(contents.select(F.col("h").alias("rh"), F.col("sh").alias("rsh")).hint("merge"), "rh")

    def verify(batches):
        names = ["h", "rh", "s", "e", "similarity"]
        for batch in batches:
            for which, s, e, j in alike_lists(batch.column(2), batch.column(3)):
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.float64())], names)
        release()

    alike = scratch.save(pair.select("h", "rh", "sh", "rsh").mapInArrow(verify, "h long, rh long, s int, e int, similarity double"))
    out = linked.join(alike.hint("merge"), ["h", "rh"]).groupBy(
        F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), (F.col("a") + F.col("s")).alias("start"), (F.col("a") + F.col("e") + (SHINGLE - 1)).alias("end"), F.col("rdoc").alias("of_doc")
    )
    out = scratch.save(out.agg(F.max("similarity").alias("similarity")))
    scratch.drop(found, linked, contents, alike)

    # spots: what lies around windows of frequent values that lie in no verified passage, and around all that share their values
    lo, hi = F.greatest("l", F.col("c") - (LEAST - 1)), F.least("c", F.col("r") - (LEAST - 1))
    begun = near.select("doc", lo.alias("a"), (hi + 1).alias("b"), "value", (F.col("d0") < F.col("doc")).alias("asks")).where("a < b")
    spans = F.collect_list(F.struct("start", "end")).alias("spans")
    verified = out.groupBy(F.col("doc_id").alias("doc"), F.col("text_hash").alias("th")).agg(spans)
    single = whose.groupBy("doc").agg(F.min("th").alias("th"), F.max("th").alias("other")).where("th = other").select("doc", "th")
    of_doc = verified.join(single.hint("merge"), ["doc", "th"], "left_semi").select("doc", "spans")  # windows do not tell texts of one id apart
    asking = begun.where("asks").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "value")).alias("w")).join(of_doc.hint("merge"), "doc", "left").select("w", "spans")

    def open_values(batches):
        for batch in batches:
            values = []
            for i in range(len(batch)):
                w, spans = batch.column(0)[i].values, batch.column(1)[i].values
                a, b, value = (w.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "value"))
                known = joined_ranges(*(spans.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))) if spans else []
                starts, ends = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
                at = np.searchsorted(starts, a, "right") - 1
                inside = (at >= 0) & (ends[at] >= b + (PASSAGE - 1)) if len(known) else np.zeros(len(a), bool)
                values.append(value[~inside])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))], ["value"])

    wanted_values = scratch.save(asking.mapInArrow(open_values, "value long").distinct())  # written, so that skewed values can be split
    ranges = begun.join(wanted_values.hint("merge"), "value", "left_semi").select("doc", "a", "b").distinct().groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("w"))
    around = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(ranges.hint("shuffle_hash"), "doc").where("text is not null")
    around = around.withColumn("th", F.xxhash64("text")).join(verified.hint("shuffle_hash"), ["doc", "th"], "left").select("doc", "text", "th", "w", "spans")

    def open_up():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(*buffers(b.column(1)), SPACED)
            shingle = words.shingles(SHINGLE)[0].view(np.int64)
            rows, parts, opens = [], [], []
            for i, (w, spans) in enumerate(zip(b.column(3), b.column(4))):
                low, high = int(words.first[i]), int(words.first[i + 1]) - SHINGLE + 1
                known = joined_ranges(*(spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))) if spans.is_valid else []
                starts, ends = (np.array([x[k] for x in known] + [1 << 40], np.int64) for k in (0, 1))
                for s, t in joined_ranges(*(w.values.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))):
                    own = shingle[low + s : max(low + s, min(low + t + LEAST - 1, high))]
                    if len(own) >= LEAST:
                        place = np.arange(s, s + len(own))
                        inside = np.searchsorted(starts, place, "right") - 1
                        rows.append((i, s, xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)))
                        parts.append(own)
                        opens.append((inside < 0) | (ends[inside] < place + SHINGLE))
            i, s, h = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(i)), b.column(2).take(pa.array(i)), pa.array(s), _lists(parts, np.int64), _lists(opens, bool)], ["h", "doc", "th", "a", "sh", "open"])

        return part

    # open: whether a shingle lies in no verified passage
    spots = scratch.save(map_slices(around, "text", open_up, "h long, doc long, th long, a long, sh array<long>, open array<boolean>"))
    scratch.drop(read, near, wanted_values)
    # equal spots are one; those behind the first document with it repeat it
    head = scratch.save(spots.groupBy("h").agg(F.min(F.struct("doc", "th", "a", "sh", "open")).alias("run")).select("h", "run.*"))
    asks = F.array_contains("open", True)
    first_of = head.select("h", F.col("doc").alias("of_doc"))
    again = spots.where(asks).select("h", "doc", "th", "a", F.size("sh").alias("n")).join(first_of.hint("merge"), "h").where("of_doc < doc")
    again = again.select(F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), F.col("a").alias("start"), (F.col("a") + F.col("n") + (SHINGLE - 1)).alias("end"), "of_doc", F.lit(1.0).alias("similarity"))

    def shingles(batches):
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            place = _ranges(np.zeros(len(n), np.int64), n).astype(np.int32)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([lists.flatten(), *(batch.column(k).take(taken) for k in (0, 1)), pa.array(place), batch.column(3).take(taken)], ["s", "h", "doc", "place", "asks"])
        release()

    parts = scratch.save(head.select("h", "doc", "sh", asks.alias("asks")).mapInArrow(shingles, "s long, h long, doc long, place int, asks boolean"))
    seen = parts.groupBy("s").agg(F.min(F.struct("doc", "h")).alias("least"), F.max(F.when(F.col("asks"), F.col("doc"))).alias("most"), F.count("*").alias("n"))
    seen = scratch.save(seen.where("least.doc < most").select("s", F.col("least.doc").alias("least"), F.col("least.h").alias("rh"), "n"))  # written, so that skewed keys can be split
    held = parts.where("asks").join(seen.hint("shuffle_hash"), "s").where("least < doc")
    shared = held.groupBy("h").agg(F.collect_list(F.struct("place", "s", "n", "rh")).alias("w"))
    shared = shared.where(F.size("w") >= MATCHED).join(head.select("h", "doc", "th", "a", "open", "sh").hint("merge"), "h").select("h", "doc", "open", "w", "sh", "th", "a")

    def keys_of(batch, i, done=()):
        """(s, rh) of shingles of which any passage that covers open places has one, with the first spot that has it."""
        opens, w, spot = (batch.column(k)[i].values for k in (2, 3, 4))
        opens = opens.to_numpy(zero_copy_only=False).copy()
        place, s, n, rh = (w.field(k).to_numpy(zero_copy_only=False) for k in ("place", "s", "n", "rh"))
        for x in done:
            opens[x["s"] : x["e"]] = False
        which = needed(place, n, spot.to_numpy(zero_copy_only=False), opens)
        return s[which], rh[which]

    def first_keys(batches):
        """Spots with keys, and these."""
        for batch in batches:
            keys = [keys_of(batch, i) for i in range(len(batch))]
            some = np.array([len(s) > 0 for s, _ in keys], bool)
            lists = [_lists([x[k] for x in keys if len(x[k])], np.int64) for k in (0, 1)]
            rows = batch.filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rows.columns, *lists], [*rows.schema.names, "s", "rh"])
        release()

    theirs = head.select(F.col("h").alias("rh"), F.col("sh").alias("rsh"), F.col("doc").alias("rdoc"))
    # with the first spot that has a shingle; what stays open then with all that have it
    asked = "h long, doc long, open array<boolean>, w array<struct<place: int, s: long, n: long, rh: long>>, sh array<long>, th long, a long"
    keyed = scratch.save(shared.mapInArrow(first_keys, f"{asked}, s array<long>, rh array<long>").withColumn("tried", F.array_distinct("rh")))
    firsts = scratch.save(keyed.select("h", F.explode("tried").alias("rh")))
    both = firsts.join(head.select("h", "sh").hint("merge"), "h").join(theirs.select("rh", "rsh").hint("merge"), "rh")
    alike = scratch.save(both.select("h", "rh", "sh", "rsh").mapInArrow(verify, "h long, rh long, s int, e int, similarity double"))
    done = alike.groupBy("h").agg(F.collect_list(F.struct("s", "e")).alias("done"))
    left = keyed.join(done.hint("merge"), "h", "left").select("h", "doc", "open", "w", "sh", "th", "a", "tried", "done", "s", "rh")
    fields = "home long, h long, doc long, th long, a long, sh array<long>, keys array<long>, early array<long>, tried array<long>"

    def to_homes(batches):
        """A row for each home of a spot's keys: the first spot that has the key. early: its keys of smaller homes."""
        for batch in batches:
            row, homes, keys, early = [], [], [], []
            for i in range(len(batch)):
                done = batch.column(8)[i].as_py()
                s, rh = keys_of(batch, i, done) if done else (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (9, 10))
                for home in np.unique(rh).tolist():
                    row.append(i)
                    homes.append(home)
                    keys.append(np.unique(s[rh == home]))
                    early.append(np.unique(s[rh < home]))
                if len(row) >= 256 or (row and i == len(batch) - 1):
                    taken = pa.array(row)
                    h, doc, th, a, sh, tried = (batch.column(k).take(taken) for k in (0, 1, 5, 6, 4, 7))
                    yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), h, doc, th, a, sh, _lists(keys, np.int64), _lists(early, np.int64), tried], ["home", "h", "doc", "th", "a", "sh", "keys", "early", "tried"])
                    row, homes, keys, early = [], [], [], []
        release()

    def in_blocks(batches):
        """Rows come by home and part, its own spots before those that ask."""
        names = ["doc_id", "text_hash", "start", "end", "links"]
        number, parts, block, out, size = None, [], None, [], 0

        def rows_of(out):
            doc, th, start, end, of_doc, similarity = (np.concatenate(x) for x in zip(*((np.full(len(x[2]), x[0]), np.full(len(x[2]), x[1]), *x[2:6]) for x in out)))
            ends = np.cumsum(np.concatenate([[0], *(x[6] for x in out)])).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(of_doc, pa.int64()), pa.array(similarity, pa.float64())], ["of_doc", "similarity"])
            at = ends[:-1] if links else slice(None)
            return pa.RecordBatch.from_arrays([*(pa.array(x[at], pa.int64()) for x in (doc, th, start, end)), pa.ListArray.from_arrays(pa.array(ends), struct)], names)

        for batch in batches:
            home, part, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((np.diff(home) != 0) | (np.diff(part) != 0) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if high == low:
                    continue
                if (home[low], part[low]) != number:
                    number, parts, block = (home[low], part[low]), [], None
                rows = batch.slice(low, high - low)
                if not asks[low]:
                    parts.append(rows.select(["h", "doc", "sh"]))
                    continue
                if block is None:
                    held = pa.Table.from_batches(parts).combine_chunks() if parts else []
                    block = Block(*(held.column(k).to_numpy() for k in (0, 1)), held.column(2).combine_chunks()) if len(held) else False
                    parts = []
                if block is False:
                    continue
                doc, th, begin = (rows.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                for i in range(len(rows)):
                    spot, keys, early, tried = (rows.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (7, 8, 9, 10))
                    which, s, e, j = block.alike(spot, block.candidates(doc[i], keys, early, tried))
                    if not len(s):
                        continue
                    s, e = begin[i] + s, begin[i] + e + (SHINGLE - 1)
                    if links:
                        by = np.lexsort((e, s))
                        s, e = s[by], e[by]
                        new = np.flatnonzero((np.diff(s, prepend=-1) != 0) | (np.diff(e, prepend=-1) != 0))
                        out.append((doc[i], th[i], s, e, block.doc[which[by]], j[by], np.diff(new, append=len(s))))
                    else:
                        s, e = (np.array(x, np.int64) for x in zip(*joined_ranges(s, e)))
                        out.append((doc[i], th[i], s, e, np.zeros(0, np.int64), np.zeros(0), np.zeros(len(s), np.int64)))
                    size += len(s)
                    if size >= HANDED:
                        yield rows_of(out)
                        out, size = [], 0
        if out:
            yield rows_of(out)
        release()

    # spots lie with the first spots that have a shingle which is asked for, those of one home in parts where they are many
    asking = scratch.save(left.mapInArrow(to_homes, fields))
    wanted_keys = asking.select(F.explode("keys").alias("s"), "home", "doc").groupBy("s", "home").agg(F.max("doc").alias("most"))
    member = parts.select("s", "h", "doc").join(wanted_keys.hint("shuffle_hash"), "s").where("doc < most").select("home", "h").distinct()
    lying = scratch.save(member.join(head.select("h", "doc", "sh").hint("merge"), "h").select("home", "h", "doc", "sh"))
    scratch.drop(parts, seen)
    total = F.sum(F.size("sh"))
    large = lying.groupBy("home").agg(F.greatest(F.ceil(total / BLOCK), F.least(F.lit(EVEN), F.ceil(total / LITTLE))).cast("int").alias("parts")).where("parts > 1")
    n, empty = F.coalesce("parts", F.lit(1)), F.lit(None).cast("array<long>")
    lie = lying.join(F.broadcast(large), "home", "left").select("home", F.pmod("h", n).cast("int").alias("part"), F.lit(False).alias("asks"), "h", "doc", F.lit(0).cast("long").alias("th"), F.lit(0).cast("long").alias("a"), "sh", empty.alias("keys"), empty.alias("early"), empty.alias("tried"))
    ask = asking.join(F.broadcast(large), "home", "left").select("home", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.lit(True).alias("asks"), "h", "doc", "th", "a", "sh", "keys", "early", "tried")
    rows = lie.union(ask).repartition("home", "part").sortWithinPartitions("home", "part", "asks")
    link = "array<struct<of_doc: bigint, similarity: double>>"
    more = scratch.save(rows.mapInArrow(in_blocks, f"doc_id long, text_hash long, start long, end long, links {link}"))
    missed = alike.join(head.select("h", "doc", "th", "a").hint("merge"), "h").join(theirs.select("rh", "rdoc").hint("merge"), "rh")
    missed = missed.select(F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), (F.col("a") + F.col("s")).alias("start"), (F.col("a") + F.col("e") + (SHINGLE - 1)).alias("end"), F.col("rdoc").alias("of_doc"), "similarity")
    whole = out.select("doc_id", "text_hash", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "of_doc", "similarity").union(again).union(missed)
    stretch = ["doc_id", "text_hash", "start", "end"]
    if links:
        # each document once, with its best similarity; a stretch may come from several blocks
        each = whole.groupBy(*stretch).agg(F.collect_list(F.struct("of_doc", "similarity")).alias("links")).union(more)
        best = each.groupBy(*stretch).agg(F.collect_list("links").alias("links")).mapInArrow(once, f"doc_id long, text_hash long, start long, end long, links {link}")
        whole = best.withColumns({k: F.col(k).cast("int") for k in ("start", "end")})
    else:
        whole = whole.select(*stretch).union(more.select(*stretch)).distinct().withColumns({k: F.col(k).cast("int") for k in ("start", "end")})
    whole = scratch.save(whole)
    scratch.drop(out, spots, head, keyed, firsts, alike, asking, lying, more)
    return whole


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of lists of (of_doc, similarity) put together, in order: each document once, with the highest similarity."""
    for batch in batches:
        lists = batch.column(4)
        flat = lists.flatten()
        n = flat.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), n)
        doc, similarity = (flat.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("of_doc", "similarity"))
        by = np.lexsort((-similarity, doc, of))
        by = by[(np.diff(of[by], prepend=-1) != 0) | (np.diff(doc[by], prepend=0) != 0)]
        ends = np.searchsorted(of[by], np.arange(len(lists) + 1)).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(doc[by]), pa.array(similarity[by])], ["of_doc", "similarity"])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), struct)], batch.schema.names)
    release()


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (which may overlap) and the white space behind them."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in sorted(spans):
        out.append(text[done : max(done, at[a])])
        done = max(done, at[min(b, len(at) - 1)])
    return b"".join([*out, text[done:]])


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (its columns, all its rows) with repeated passages cut from all documents but the first that has them.

    Texts without a repeat stay byte for byte, null texts null; n_chars, where there is such a column, follows.
    Rows with a null id stay as they are; an empty table gives an empty one. Columns of any name are kept.
    """
    doc, th, spans, new = unused(docs, "doc", "th", "spans", "cut")
    found = repeated(docs, links=False).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias(spans))
    found = found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(th), spans)
    joined = docs.join(found, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left").select(*docs.columns, spans)

    def make():
        def part(texts: pa.Array, spans: pa.Array) -> pa.Array:
            both = zip(texts.to_pylist(), spans.to_pylist())
            return pa.array([None if own is None else cut(t.encode(), [(s["start"], s["end"]) for s in own]).decode() for t, own in both], pa.string())

        return part

    small_batches(docs)
    hit = F.col(spans).isNotNull()
    joined = joined.withColumn(new, text_udf(make, "string")(F.when(hit, F.col("text")), F.col(spans)))
    fresh = {"text": F.when(hit, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(hit, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(fresh).select(docs.columns)
