"""Open spots lie with the first holders of the shingles they ask for, and are compared there as `passages` does."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from shorefall.llm import queries, windows
from shorefall.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_block_finds_what_passages_finds():
    rng, found = np.random.default_rng(13), 0
    for k in range(24):
        base = rng.integers(1, 1 << 62, 400) if k % 3 else rng.integers(1, (60, 12)[k % 2], 300)
        base = base if k % 5 else np.tile(base[:40], 8)
        spots = []
        for _ in range(24):
            a = int(rng.integers(0, 150))
            own = base[a : a + int(rng.integers(20, 170))].copy()
            gone = rng.random(len(own)) < rng.choice([0, 0.05, 0.12, 0.3])
            own[gone] = rng.integers(1 << 40, 1 << 62, int(gone.sum()))
            spots.append(np.concatenate([own[len(own) // 2 :], own[: len(own) // 2]]) if rng.random() < 0.3 else own)
        lists = pa.array([s.tolist() for s in spots], pa.list_(pa.int64()))
        block, others = windows.Block(np.arange(24), np.arange(24), lists), np.sort(rng.choice(24, 16, replace=False))
        for spot in spots:
            got = sorted(zip(*(x.tolist() for x in block.alike(spot, others))))
            own = pa.array([spot.tolist()] * 16, pa.list_(pa.int64()))
            assert got == sorted((int(others[p]), *r) for p, *r in windows.passages(own, lists.take(pa.array(others))))
            found += len(got)
    assert found > 500


def near_copies(spark):
    """Of 12 texts 10 copies each, with some words changed."""
    rng, rows = random.Random(17), []
    for k in range(12):
        base = [f"w{k}_{i}" for i in range(150)]
        rows += [[w if rng.random() > 1 / 22 else f"n{rng.randrange(10**6)}" for w in base] for _ in range(30)]
    return spark.createDataFrame([(i, " ".join(t), "en", "s", 9) for i, t in enumerate(rows)], DOC)


def test_spots_go_to_the_homes_of_their_keys_alone(spark, monkeypatch, tmp_path):
    sent, handed, save = [], [], Scratch.save

    def watched(self, df, *args):
        out = save(self, df, *args)
        if "tried" in df.columns and "keys" in df.columns:
            sent.append((out.count(), out.select("h").distinct().count()))
        return out

    monkeypatch.setattr(Scratch, "save", watched)
    monkeypatch.setattr(windows, "LITTLE", 1 << 11)  # several blocks
    docs = near_copies(spark)
    links = {(r.doc_id, r.of_doc) for r in windows.repeats(docs).collect()}
    (rows, spots), = sent
    assert spots > 50 and rows < 3 * spots, sent
    assert all(a // 30 == b // 30 and b < a for a, b in links)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_windows(spark, str(tmp_path)).collect()
    each = {}
    for r in windows.repeats(docs).collect():
        each.setdefault((r.doc_id, r.start, r.end), []).append((r.of_doc, r.similarity))
    assert {(r.doc_id, r.start, r.end): (r.n_docs, r.of_doc, r.similarity) for r in rows} == {k: (len(v), *min(v)) for k, v in each.items()}
    handed = {}
    for r in windows.repeated(docs, links=False).collect():
        handed.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = {}
    for d, a, b in each:
        want.setdefault(d, set()).update(range(a, b))
    assert handed == want
