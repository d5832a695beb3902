"""Spots that stay open meet all earlier ones in blocks: no table has a row for each pair, and no pair is lost."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from shorefall.llm import windows
from shorefall.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_are_no_rows_of_pairs(spark, monkeypatch):
    rng, pairs, save = random.Random(5), [], Scratch.save

    def watched(self, df, *args):
        out = save(self, df, *args)
        if set(df.columns) == {"h", "rh"}:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", watched)
    monkeypatch.setattr(windows, "LITTLE", 1 << 11, raising=False)  # several blocks
    base = [f"w{i}" for i in range(150)]
    rows = [[w if rng.random() > 1 / 22 else f"n{rng.randrange(10**6)}" for w in base] for _ in range(90)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 9) for i, t in enumerate(rows)], DOC)
    found = windows.repeats(docs).collect()
    assert sum(pairs) < 90 * 12, pairs  # a row for each of the first holders
    linked = {(r.doc_id, r.of_doc) for r in found}
    assert len(linked) > 90 * 12 and len({d for d, _ in linked}) > 60
    for r in found:
        assert r.of_doc < r.doc_id and r.similarity >= windows.SIMILAR and r.end - r.start >= windows.PASSAGE


def test_a_block_leaves_out_no_pair_with_a_passage():
    rng, kept, left_out = np.random.default_rng(3), 0, 0
    for k in range(40):
        base = rng.integers(1, 1 << 62, 160) if k % 3 else rng.integers(1, 60, 160)  # some with repeats
        spots = []
        for _ in range(24):
            a = int(rng.integers(0, 100))
            own = base[a : a + int(rng.integers(46, 160))].copy()
            gone = rng.random(len(own)) < rng.choice([0, 0.05, 0.12, 0.3])
            own[gone] = rng.integers(1 << 40, 1 << 62, int(gone.sum()))
            spots.append(own)
        lists = pa.array([s.tolist() for s in spots], pa.list_(pa.int64()))
        doc, h = np.arange(24), np.arange(24) * 7
        block, i = windows.Block(h, doc, lists), int(rng.integers(12, 24))
        if len(spots[i]) < windows.LEAST:
            continue
        got = set(block.partners(i, spots[i], np.unique(spots[i]), h[:3]).tolist())
        assert got <= set(range(3, i))
        for j in range(3, i):
            if windows.passages(lists.slice(i, 1), lists.slice(j, 1)):
                kept += 1
                assert j in got, (k, i, j)
            else:
                left_out += j not in got
    assert kept > 100 and left_out > 50
