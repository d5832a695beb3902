"""Shingles that spots around frequent values ask with, and the rows of op7_windows."""

from __future__ import annotations

import random

import numpy as np

from shorefall.llm import queries, windows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_no_passage_of_any_length_without_one_of_the_needed_shingles():
    rng, tried = np.random.default_rng(11), 0
    for k in range(400):
        m = int(rng.integers(windows.LEAST, (90, 150, 400)[k % 3]))
        spot = rng.permutation(m) if k % 4 else rng.integers(0, m // 2, m)  # some with repeats
        n_of = np.where(rng.random(m) < rng.choice([0.85, 0.95, 1]), rng.integers(2, 4000, m), 0)
        place = np.flatnonzero(n_of[spot] > 0)
        opens = rng.random(m) < rng.choice([0.02, 0.3, 1])
        if k % 5 == 0:  # a gap of open places
            opens[:] = False
            opens[m // 2 : m // 2 + int(rng.integers(1, 9))] = True
        chosen = set(spot[place[windows.needed(place, n_of[spot[place]], spot, opens)]].tolist())
        for _ in range(30):
            a = int(rng.integers(0, m - windows.LEAST + 1))
            b = int(rng.integers(a + windows.LEAST, m + 1))
            here = spot[a:b]
            distinct, shared = set(here.tolist()), {x for x in here.tolist() if n_of[x]}
            ends = {here[0], here[-1]}
            least = -(-4 * len(distinct) // 5)
            if not ends <= shared or len(shared) < least:
                continue
            # an adversary leaves out chosen ones first
            match = sorted(shared - ends, key=lambda x: x in chosen)[: least - len(ends)]
            match = set(match) | ends
            if len(match) >= least and opens[a:b].any():
                hit = [p for p in range(a, b) if spot[p] in match]
                covers_gap = max(np.diff(hit)) > 1 and any(opens[p] for p in range(a, b))
                if any(opens[p] for p in hit) or covers_gap:
                    tried += 1
                    assert chosen & match, (k, a, b)
    assert tried > 500


def test_a_shared_line_that_is_no_passage_asks_nothing():
    spot, place = np.arange(90), np.arange(45, 89)  # 44 shingles that others have behind 45 of its own
    opens = np.ones(90, bool)
    assert len(windows.rarest(place, spot[place], np.full(44, 14547), opens))
    assert len(windows.needed(place, np.full(44, 14547), spot, opens)) == 0
    place = np.arange(40, 90)
    assert len(windows.needed(place, np.full(50, 14547), spot, opens))


def test_a_repeated_stretch_is_one_row_with_its_number_of_links(spark, tmp_path):
    rng = random.Random(101)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    texts = [" ".join(words(20 + i) + passage + words(30)) for i in range(4)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_windows(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.of_doc, r.n_docs) for r in rows) == [(i, 20 + i, 80 + i, 0, i) for i in (1, 2, 3)]


def test_letters_beyond_ascii_are_shown_together():
    import public_tokenizers

    from shorefall.llm import dac

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = dac.Encoder(f.read())
    stems = ["plain", "é", "中文", "naïve", "x" * 70, "İß"]
    for before in (" ", ""):
        want = [own._bytes(own.lib.encode(before + s, add_special_tokens=False).ids) for s in stems]
        assert own._pieces(before, stems) == want and stems[1] == "é"
    assert own.stems.look_up(["x" * 70, "ab"], own._letters) == own._letters(["x" * 70, "ab"]) and list(own.stems.young) == ["ab"]
