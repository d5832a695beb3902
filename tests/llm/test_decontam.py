"""Automaton of benchmark items: memory, and rows against brute force where windows, ties and items overlap."""

from __future__ import annotations

import pickle
import random
import subprocess
import sys

from shorefall.llm import decontam

CHILD = """
import pickle, random, resource, sys
from shorefall.llm.decontam import Automaton
rng = random.Random(1)
items, size = [], 0
while size < 4 << 20:
    own = [b"%x" % rng.randrange(1 << 18) for _ in range(35)]
    items.append((str(len(items)), own))
    size += sum(map(len, own)) + 34
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
made = Automaton(items)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(pickle.dumps(made)), len(made.link), sum(len(w) for _, w in items))
"""


def test_a_block_of_items_takes_memory_in_proportion():
    out = subprocess.run([sys.executable, "-c", CHILD], capture_output=True, text=True, check=True).stdout.split()
    kb, pickled, states, words = map(int, out)
    assert kb < 300_000 and pickled < 150 << 20 and states <= 2 * words + 1


def slow(ws, items, window):
    spans, found = [], set()
    for i, (_, own) in enumerate(items):
        n = min(window, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        for j in range(len(ws) - n + 1):
            if tuple(ws[j : j + n]) in grams:
                spans.append((j, j + n))
                found.add(i)
    return decontam.merged(spans), found


def test_matches_against_brute_force():
    rng = random.Random(4)
    for trial in range(60):
        alphabet = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        pick = lambda n: [rng.choice(alphabet) for _ in range(n)]
        items = [(f"{i:03}", pick(rng.randint(1, 14))) for i in range(rng.randint(1, 25))]
        window = rng.choice([1, 3, 5, 10])
        made = pickle.loads(pickle.dumps(decontam.Automaton(items, window)))
        for _ in range(10):
            ws = [w if rng.random() > 0.05 else b"unknown" for w in pick(rng.randint(0, 80))]
            assert made.match(ws) == slow(ws, items, window)
