"""Counting tokens with a deterministic transducer compiled from a BPE vocabulary.

A sequence of tokens is what BPE gives for its text exactly if each neighbouring pair is what BPE gives for
the pair's own text, and the tokenisation of each prefix has one last token. So a finite state is enough to
read a text character by character: the last token of the prefix read so far, and for each suffix that may
still grow into a piece, its place in the trie, the last token before it, and how many tokens fewer there
were. Reading a character moves to the next state and emits the change in the number of tokens. States and
transitions are made when first met.

A line feed, and a white-space marker behind another character, lead to one state from all states, so the state
map of a chunk that begins there is constant: chunks compose by adding counts, which a segmented scan does for
all texts of a slice at once. Counts of chunks met before are kept in a bounded table.

A chunk longer than PIECE (no blanks: Chinese, minified code) is cut at every PIECE characters. Each piece gets a
state map of its own, without knowing what stands before it: entry state -> (exit state, tokens), for the entry
states that reading on from several places shortly before the piece leads to. A prefix scan composes the maps.
Where the true entry state is not in a piece's map, that piece is read from it, so counts are exact anyway.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .spchunks import MARK
from .text import map_slices

#: Transitions and chunks that a worker keeps at most; beyond, it starts again from none.
STATES, TABLE, LONGEST = 400_000, 300_000, 64
#: Characters of a piece of a long chunk, how far before a piece reading begins, and how many places it begins at.
PIECE, AHEAD, STARTS = 1 << 14, 256, 16
NONE = -1
FEED = "\n"
#: A state that outlives the numbering: the last token, and (place in the trie, token before, tokens fewer) of growing suffixes.
Key = tuple[int, tuple[tuple[int, int, int], ...]]
StateMap = dict[Key, tuple[Key, int]]
START: Key = (NONE, ())


def composed(first: StateMap, second: StateMap) -> StateMap:
    """State map of two pieces, one behind the other; entry states whose exit the second does not know are left out."""
    return {k: (second[out][0], n + second[out][1]) for k, (out, n) in first.items() if out in second}


def scanned(maps: list[StateMap]) -> list[StateMap]:
    """State maps of all prefixes, each round over twice the distance."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [composed(a, b) for a, b in zip(maps, maps[step:])]
        step *= 2
    return maps


class Transducer:
    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.piece = list(self.score)
        self.number = {p: i for i, p in enumerate(self.piece)}
        self.cuts = not any(MARK in p.lstrip(MARK) or FEED in p for p in self.piece)
        if any(c not in self.number for p in self.piece for c in p):
            raise ValueError("each character of a piece must be a piece")
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[int] = [NONE]
        for p, i in self.number.items():
            at = 0
            for c in p:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(NONE)
                at = self.trie[at][c]
            self.ends[at] = i
        order = sorted(range(len(self.piece)), key=lambda i: -self.score[self.piece[i]])
        self.rank = dict(zip(order, range(len(order))))
        self.cut: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.bare: dict[str, int] = {}  # tokens of words at the begin of a line
        self.marked: dict[str, int] = {}  # tokens of words behind a marker
        self._forget()

    def _forget(self) -> None:
        self.states: dict[Key, int] = {START: 0}
        self.keys: list[Key] = [START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.made = 0

    def _bound(self) -> None:
        """Between chunks or pieces: what has been kept stays bounded; numbers of states do not outlive this."""
        if self.made > STATES:
            self._forget()
        if len(self.fits) > STATES:
            self.fits = {}

    def state(self, key: Key) -> int:
        """Number of a state, made when first met."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return found

    def bpe(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbouring pair merges first, the leftmost of equals."""
        out = list(text)
        while True:
            best = None
            for i in range(len(out) - 1):
                s = self.score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return out
            i = best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]

    def halves(self, t: int) -> tuple[int, int]:
        """The two pieces that merge last in piece t; a piece that merging never makes, or a character, is its own."""
        got = self.cut.get(t)
        if got is None:
            text, got = self.piece[t], (t, t)
            if len(text) > 1 and self.bpe(text) == [text]:
                # all but the last merge: merging without the piece itself
                score, self.score[text] = self.score[text], None
                two = self.bpe(text)
                self.score[text] = score
                got = (self.number[two[0]], self.number[two[1]])
            self.cut[t] = got
        return got

    def pair(self, a: int, b: int) -> bool:
        """Whether token b can stand behind token a (or behind nothing).

        Undoes merges on both sides of the border, the later one first. If the pieces at the border could
        have merged before the merge that is undone, they would have: the pair does not occur.
        """
        found = self.fits.get((a, b))
        if found is not None:
            return found
        key, limit = (a, b), None
        found = (len(self.piece[b]) == 1 or self.halves(b) != (b, b)) and (a == NONE or len(self.piece[a]) == 1 or self.halves(a) != (a, a))
        while found and a != NONE:
            both = self.number.get(self.piece[a] + self.piece[b])
            if both is not None and (limit is None or self.rank[both] < limit):
                found = False
                break
            ha, hb = self.halves(a)[1], self.halves(b)[0]
            if ha == a and hb == b:
                break
            if hb == b or (ha != a and self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], ha
            else:
                limit, b = self.rank[b] + 1, hb
        self.fits[key] = found
        return found

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The state behind c, and the tokens that it adds."""
        last, grown = self.keys[state]
        if c not in self.trie[0]:  # spelt in bytes; no piece goes across
            key, change = START, len(c.encode())
        else:
            token, change, going = NONE, 0, []
            for node, before, less in (*grown, (0, last, 0)):
                node = self.trie[node].get(c, 0)
                if not node:
                    continue
                p = self.ends[node]
                if p != NONE and token == NONE and self.pair(before, p):
                    token, change = p, less + 1
                if self.trie[node]:
                    going.append((node, before, less))
            key = (token, tuple((n, b, x - change) for n, b, x in going))
        to = self.state(key)
        self.moves[state][c] = to, change
        self.made += 1
        return to, change

    def read(self, text: str, state: int) -> tuple[int, int]:
        """The state behind a text that is read from a state, and the tokens."""
        n = 0
        moves, step = self.moves, self.step
        for c in text:
            got = moves[state].get(c)
            state, more = got if got is not None else step(state, c)
            n += more
        return state, n

    def state_map(self, chunk: str, begin: int) -> StateMap:
        """State map of the piece [begin, begin + PIECE) of a chunk."""
        self._bound()
        end, states = begin + PIECE, {0}
        for at in range(max(0, begin - AHEAD), begin):
            states = {self.read(chunk[at], s)[0] for s in states}
            if at - begin + AHEAD < STARTS - 1:
                states.add(0)
        # entry states whose runs have met go on as one: (tokens, entry states with the tokens they have more)
        runs = {s: (0, [(self.keys[s], 0)]) for s in states}
        at = begin
        while len(runs) > 1 and at < min(end, len(chunk)):
            moved: dict[int, tuple[int, list[tuple[Key, int]]]] = {}
            for s, (n, entries) in runs.items():
                to, more = self.read(chunk[at], s)
                if to in moved:
                    moved[to][1].extend((k, d + n + more - moved[to][0]) for k, d in entries)
                else:
                    moved[to] = n + more, entries
            runs, at = moved, at + 1
        out: StateMap = {}
        for s, (n, entries) in runs.items():
            to, more = self.read(chunk[at:end], s)
            out.update((k, (self.keys[to], n + more + d)) for k, d in entries)
        return out

    def run(self, chunk: str) -> int:
        """Tokens of a chunk, read from the state behind an unknown character."""
        if len(chunk) <= PIECE:
            self._bound()
            return self.read(chunk, 0)[1]
        begins = range(0, len(chunk), PIECE)
        maps = [self.state_map(chunk, a) for a in begins]
        known = [m[START] for m in scanned(maps) if START in m]
        key, n = known[-1]
        for i in range(len(known), len(maps)):  # behind a piece whose map lacks the true entry state
            got = maps[i].get(key)
            if got is None:
                self._bound()
                to, more = self.read(chunk[begins[i] : begins[i] + PIECE], self.state(key))
                got = self.keys[to], more
            key, n = got[0], n + got[1]
        return n

    def lines(self, text: str) -> list[list[str]] | None:
        """Words of each line; None where a run of blanks (pieces of equal score, which the library alone orders) or the marker occurs."""
        if MARK in text or not self.cuts:
            return None
        out = [line.split(" ") for line in text.split(FEED)]
        if out[0][0] == "" or any("" in line[1:] for line in out if len(line) > 1):
            return None
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text.

        A chunk is a word behind a marker, or one at the begin of a line: no piece holds a line feed, which is
        spelt in bytes, so the state behind it is one as well.
        """
        split = [self.lines(t) for t in texts]
        bare, marked = set(), set()
        for own in split:
            if own:
                marked.add(own[0][0])
                for line in own:
                    marked.update(line[1:])
                bare.update([line[0] for line in own[1:]])
        if len(self.bare) + len(self.marked) + len(bare) + len(marked) > TABLE:
            self.bare, self.marked = {}, {}
        run, long = self.run, []
        for table, before, words in ((self.bare, "", bare), (self.marked, MARK, marked)):
            for w in words.difference(table):
                table[w] = run(before + w)
                if len(w) > LONGEST:
                    long.append((table, w))
        of_bare, of_marked = self.bare, self.marked
        flat: list[int] = []
        ends = [0]
        for own in split:
            if own:
                flat.append(of_marked[own[0][0]])
                for line in own:
                    flat += [of_marked[w] for w in line[1:]]
                flat += [of_bare[line[0]] + 1 for line in own[1:]]
            ends.append(len(flat))
        sums = np.concatenate([[0], np.cumsum(np.array(flat, np.int64))])
        out = sums[ends[1:]] - sums[ends[:-1]]
        for i, own in enumerate(split):
            if own is None:
                out[i] = len(self.sp.encode(texts[i], num_threads=1))
        for table, w in long:
            del table[w]
        return out


_made: dict[int, Transducer] = {}


def _transducer(key: int, model: bytes) -> Transducer:
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(model)
    return _made[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null text counts as empty, a null id stays null; repeated rows give a row each, an empty table none. Columns
    other than doc_id and text are not read. The pieces of a long chunk are read in the task that holds its row.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash(model)

    def make():
        own = _transducer(key, sent.value)

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = own.count(texts)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return part

    return map_slices(docs.select("doc_id", "text"), "text", make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
