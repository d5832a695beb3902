"""Dual-tree search, source mixing and the prefix trie against brute force, and their queries against SQL."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.llm import dualtree, mixing, queries, trie
from shorefall.llm.running import running
from shorefall.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_dualtree", "op12_mixing", "op13_trie"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and got and set(df.columns) == set(want.columns)


# --- dual tree


def terms_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def slow_rank(docs, items, k):
    own = [(i, terms_of(t)) for i, t in docs]
    n, total = sum(bool(ts) for _, ts in own), sum(len(ts) for _, ts in own)
    out = []
    for item, text in items:
        scores = []
        for doc, ts in own:
            s = 0
            for t in set(terms_of(text)):
                if tf := ts.count(t):
                    df = sum(t in set(x) for _, x in own)
                    m = 50 + 50 * len(ts) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranked_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(dualtree, "CHUNK", 32)
    monkeypatch.setattr(dualtree, "LEAF", 4)
    monkeypatch.setattr(dualtree, "FAN", 2)
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "été", "x1", "日本"]) + rng.choice(["", "b", "C", "2"])
    text = lambda n: "".join(word() + rng.choice([" ", "_", "\n", "—", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 12))) for i in range(150)] + [(7, "a b a"), (None, "a b a"), (900, None), (901, ""), (902, "  --  "), (903, "ab " * 5000)]
    docs += [(910 + i, "a b C2") for i in range(40)]  # ties at the end of the list
    items = [(i, text(rng.randint(1, 6))) for i in range(9)] + [(9, None), (10, ""), (3, "a été"), (None, "zz a"), (12, "nowhere")]
    d = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs], DOCS).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2)).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((tuple(r) for r in dualtree.ranked(d, q, 7).collect()), key=str)
    assert got == slow_rank(docs, items, 7)


def test_ranked_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dualtree.ranked(docs, items).collect() == []
    assert dualtree.ranked(spark.createDataFrame([(1, "a", None, None, 1)], DOCS), items.limit(0)).collect() == []
    assert dualtree.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text_is_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "SLICE_BYTES", 1 << 12)
    text = "alpha beta " * 3000 + "q" * 20000 + " beta"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = dualtree.frequencies(d, ["beta", "alpha", "gamma"], "doc_id", "text").first()
    assert (r.n, dict(zip(r.terms, r.tfs))) == (6002, {0: 3001, 1: 3000})


def test_bounds_leave_batches_unscored():
    """Documents in topics: an item's topic is scored, most others are left with their nodes."""
    rng = np.random.default_rng(2)
    topics, own, n = 16, 40, 2048
    items = dualtree.Items([np.sort(rng.choice(own, 12, replace=False)) + own * (i % topics) for i in range(64)], rng.integers(1000, 9000, topics * own))
    best = dualtree.Best(5, np.ones(64, np.int64))
    s = dualtree.Search(items, best, n, n * 60)
    for at in range(0, n, 1024):
        terms = [np.sort(rng.choice(own, 20, replace=False)) + own * int(rng.integers(topics)) for _ in range(1024)]
        s.chunk(np.arange(at, at + 1024), np.zeros(1024, bool), np.full(1024, 60), np.arange(0, 1024 * 20 + 1, 20), np.concatenate(terms), rng.integers(1, 4, 1024 * 20))
    assert s.scored < 0.2 * 64 * n and len(best.kept[0]) == 64 * 5


# --- mixing


def test_targets_fill_by_weight(spark):
    rng = random.Random(1)
    for sizes in ([100, 100, 100], [0, 5, 1000, 7, 3], [1], [0, 0], [rng.randint(0, 500) for _ in range(40)]):
        names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, size long"), Scratch(spark)).collect()}
        left, want, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
        while open_:  # the rule of the contract, round by round
            whole = sum(mixing.WEIGHTS[i % 3] for i in open_)
            share = {i: left * mixing.WEIGHTS[i % 3] / whole for i in open_}
            over = {i for i in open_ if share[i] > 2 * sizes[i]}
            for i in over or open_:
                want[i] = 2.0 * sizes[i] if over else share[i]
            left -= sum(2 * sizes[i] for i in over)
            open_ = open_ - over if over else set()
        assert all(math.isclose(got[n], w, abs_tol=1e-6) for n, w in zip(names, want)) and len(got) == len(sizes)


def test_mix_takes_budgets_and_agrees_with_itself(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "x", rng.choice(["big"] * 6 + ["b", "é", None]), 0) for i in range(600)]
    rows += [(5, " ".join(["w"] * k), "x", "b", 0) for k in range(1, 9)]  # one id and one key, but sizes of their own
    rows += [(5, "same row", "x", "big", 0)] * 20 + [(None, "no id", "x", "b", 0), (700, None, "x", "b", 0), (701, "", "x", "alone", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash")).withColumn("key", F.lit(1))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size and sum(r.taken for r in own) == math.floor(target)
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
        full = math.floor(target / size) if size else 0
        part = [r for r in sorted(own, key=lambda r: (r.key, r.doc_id or -1, r["size"])) if r["size"]]
        kinds = [(r.taken - full * r["size"]) / r["size"] for r in part]
        assert kinds == sorted(kinds, reverse=True)  # whole documents in the order of keys, then one in part, then none
        assert sum(0 < k < 1 for k in kinds) <= 1


def test_heavier_documents_come_first_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("q"))
    first = mixing.mix(docs, share=0.1, quality=F.col("q")).where("taken > 0").collect()
    heavy = sum(r.doc_id % 2 == 0 for r in first)
    assert len(first) == 400 and 260 < heavy < 340  # three in four


def test_mixed_texts(spark):
    docs = spark.createDataFrame([(1, "a b  c", "s"), (2, "d e f g h", "s"), (3, None, "s"), (4, "x", "t")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    want = {r.doc_id: r.taken for r in mixed.collect()}
    out = mixing.texts(docs, mixed)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + len(r.text.split())
    assert found == {k: v for k, v in want.items() if v}


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    r = mixing.mix(spark.createDataFrame([(1, None, None, None, 0)], DOCS)).first()
    assert (r["size"], r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randint(0, 50), 1) for _ in range(3000)] + [("hot", 7, 2)] * 500 + [(rng.choice(["a", "b", None]), rng.randint(0, 9), 3) for _ in range(200)]
    df = Scratch(spark).save(spark.createDataFrame(rows, "g string, o int, v long"))
    got = running(df, Scratch(spark), ["g"], [F.col("o")], {"before": F.col("v")}).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.o, r.before, r.v))
    for own in by.values():
        total = 0
        for _, before, v in sorted(own):
            assert before == total
            total += v
    assert sorted(map(str, [(r.g, r.o, r.v) for r in got])) == sorted(map(str, rows))


# --- trie


def slow_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.md5((role or "").encode()).hexdigest(), hashlib.md5((text or "").encode()).hexdigest()), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for p, cs in nodes.items():
        below = [x for x in nodes if x[: len(p)] == p]
        kids = [x for x in below if len(x) == len(p) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in nodes if y)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(150, 170), 200, 305, -5, -101]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "bot", None]), rng.choice(["", "héllo", "x", None])))
    rows += [(7, t, "user", f"t{t // 3}") for t in range(60)] + [(8, t, "user", f"t{t // 3}") for t in range(70)]  # deep ones
    rows += [(c, 0, "user", "only") for c in range(400, 430)] + [(401, 0, "user", "only")] * 2 + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_convs", F.lit("clash"))
    got = sorted((tuple(r) for r in trie.forked_trie(df).collect()), key=str)
    assert got == slow_trie(rows)


@pytest.mark.parametrize("band", [2, 3, 8])
def test_bands_do_not_change_totals(spark, band):
    rng = random.Random(band)
    made = {c: [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 25))] for c in range(30)}
    made |= {c: made[5] for c in range(40, 45)}
    turns = [(c, i + 1, "", hashlib.md5(t.encode()).hexdigest(), len(t)) for c, ts in made.items() for i, t in enumerate(ts)]
    scratch = Scratch(spark)
    convs = spark.createDataFrame([(c, len(t)) for c, t in made.items()], "conv long, n long")
    df = trie.prefix_trie(convs, spark.createDataFrame(turns, "conv long, pos long, role string, text string, cps long"), scratch, band)
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    want = {(min(cs), len(p)): (sum(all(y[: len(x)] != x or y == x for y in nodes) for x in nodes if x[: len(p)] == p), sum((len(nodes[x]) - 1) * len(x[-1]) for x in nodes if x and x[: len(p)] == p)) for p, cs in nodes.items()}
    assert {(r.conv_id, r.depth): (r.n_leaves, r.saved_tokens) for r in df.collect()} == want


def test_trie_empty(spark):
    df = trie.forked_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert df.collect() == [] and df.columns == list(trie._NODE)
