"""Near passages behind smaller documents that hold parts of them: rare and frequent values, one word changed, more or less."""

from __future__ import annotations

import random

import numpy as np
import pytest

from shorefall.llm import windows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(passage, how, rng):
    at = rng.randint(8, len(passage) - 9)
    return passage[:at] + {"other": ["changed"], "more": ["put", passage[at]], "less": []}[how] + passage[at + 1 :]


@pytest.mark.parametrize("holders", [2, 24])
def test_near_passages_behind_smaller_documents_with_parts_of_them(spark, holders):
    rng, rows, want, n = random.Random(83 + holders), [], {}, 0
    for k in range(24):
        passage = words_of(rng, rng.randint(56, 62))
        near = changed(passage, ("other", "more", "less")[k % 3], rng)
        cut = next(i for i in range(len(passage)) if i == len(near) or passage[i] != near[i])
        parts = [passage[:cut], passage[cut:]]
        for i in range(holders):
            rows.append((n, " ".join(words_of(rng, 20) + parts[i % 2] + words_of(rng, 60))))
            n += 1
        lead = words_of(rng, 30)
        rows += [(n, " ".join(words_of(rng, 25) + passage + words_of(rng, 25))), (n + 1, " ".join(lead + near + words_of(rng, 30)))]
        want[n + 1] = (n, 30, 30 + len(near))
        n += 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    found = {}
    for r in windows.repeats(docs).collect():
        assert r.of_doc < r.doc_id and r.similarity >= windows.SIMILAR and r.end - r.start >= windows.PASSAGE
        if r.doc_id in want and r.of_doc == want[r.doc_id][0]:
            _, a, b = want[r.doc_id]
            assert a - 1 <= r.start and r.end <= b + 1
            found[r.doc_id] = max(found.get(r.doc_id, 0), r.end - r.start)
    assert len(found) >= (24 if holders > windows.FEW else 22), sorted(set(want) - set(found))


def test_keys_of_runs_with_one_word_changed():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 51).astype(np.uint64)
    for edit in range(51):
        other, less = base[:50].copy(), np.delete(base, edit)
        keys = [windows.Runs(w, np.array([0])) for w in (base, other, less)]
        if edit < 50:
            other[edit] = 7
            keys[1] = windows.Runs(other, np.array([0]))
        sets = []
        for r in keys:
            key, which, bit = r.coarse(np.array([7]))
            sets.append(dict(zip(zip(key.tolist()), bit.tolist())))
        for i in (1, 2):
            if i == 1 and edit == 50:
                continue
            common = set(sets[0]) & set(sets[i])
            bits = [np.array([sum({s[c] for c in common})]) for s in (sets[0], sets[i])]
            a, b = ([set(zip(k.tolist(), (kind == 2).tolist())) for k, _, _, kind in [r.keys(x)]][0] for r, x in zip((keys[0], keys[i]), bits))
            assert {k for k, _ in a} & {k for k, _ in b}, (i, edit)


def test_pipeline_cuts_a_near_passage_behind_holders_of_its_parts(spark):
    import corpus_pipeline

    rng = random.Random(89)
    passage = words_of(rng, 60)
    near = [*passage[:30], "changed", *passage[31:]]
    texts = [" ".join(words_of(rng, 20) + (passage[:31], passage[31:])[i % 2] + words_of(rng, 60)) for i in range(24)]
    lead, tail = words_of(rng, 30), words_of(rng, 30)
    texts += [" ".join(words_of(rng, 25) + passage + words_of(rng, 25)), " ".join(lead + near + tail)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    out = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert out[25].split() == lead + tail and all(out[i] == t for i, t in enumerate(texts[:25]))
