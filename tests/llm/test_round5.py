"""Near passages behind many holders of their parts, with edits that no run of PASSAGE words with one changed word holds."""

from __future__ import annotations

import random

import numpy as np

from shorefall.llm import windows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_two_changed_words_behind_many_holders_of_the_parts(spark):
    rng, rows, want, n = random.Random(97), [], {}, 0
    for k in range(10):
        passage = words_of(rng, 60)
        at = 29
        near = passage[:at] + (["put", "here"] if k % 2 else ["put"]) + passage[at + 2 :]  # other two words, or one for two
        parts = [passage[:at], passage[at + 2 :]]
        for i in range(48):
            rows.append((n, " ".join(words_of(rng, 20) + parts[i % 2] + words_of(rng, 60))))
            n += 1
        lead = words_of(rng, 30)
        rows += [(n, " ".join(words_of(rng, 25) + passage + words_of(rng, 25))), (n + 1, " ".join(lead + near + words_of(rng, 30)))]
        want[n + 1] = (n, 30, 30 + len(near))
        n += 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    found = set()
    for r in windows.repeats(docs).collect():
        assert r.of_doc < r.doc_id and r.similarity >= windows.SIMILAR and r.end - r.start >= windows.PASSAGE
        if r.doc_id in want and r.of_doc == want[r.doc_id][0]:
            _, a, b = want[r.doc_id]
            assert a - 1 <= r.start and r.end <= b + 1
            found.add(r.doc_id)
    assert found == set(want), sorted(set(want) - found)


def test_no_similar_run_without_one_of_the_chosen_shingles():
    rng = np.random.default_rng(7)
    for _ in range(60):
        m = int(rng.integers(windows.LEAST, 90))
        place = np.flatnonzero(rng.random(m) < rng.choice([0.6, 0.8, 0.95]))
        n, opens = rng.integers(2, 40, len(place)), rng.random(m) < rng.choice([0.02, 0.3, 1])
        chosen = set(place[windows.rarest(place, rng.integers(0, 2**62, len(place)), n, opens)].tolist())
        for s in range(m - windows.LEAST + 1):
            run = np.arange(s, s + windows.LEAST)
            for _ in range(3):  # a match of MATCHED shingles that covers an open place
                here = [p for p in run.tolist() if p in set(place.tolist())]
                if len(here) < windows.MATCHED:
                    continue
                match = sorted(rng.choice(here, windows.MATCHED, replace=False).tolist())
                if any(opens[p] for p in match):
                    assert chosen & set(match), (s, match)
