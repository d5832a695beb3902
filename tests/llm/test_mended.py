"""Cases that earlier versions got wrong, or that show a bound: op2, op3, op6, op9."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from shorefall.llm import decontam, html_text, spchunks, voronoi


@pytest.mark.parametrize("weights", [html_text.Weights([]), None])
def test_notices_inside_an_article_and_replies_behind_it(weights):
    words = [f"w{i}" for i in range(40)]
    weights = weights or html_text.Weights.of([f"<nav>a b</nav><article><p>{' '.join(words)}</p></article><footer>c</footer>"] * 5)
    page = f"<article><h1>Title here</h1><p>{' '.join(words)}</p><div class='notice'>This page needs cookies</div><div class='alert'>Subscribe now please</div><p>and the end</p></article>"
    assert html_text.main_text(page, weights) == "Title here " + " ".join(words) + " and the end"
    page = f"<article><p>{' '.join(words)}</p></article><section id='responses'><p>{' '.join('reply%d' % i for i in range(120))}</p></section>"
    assert html_text.main_text(page, weights) == " ".join(words)
    # a teaser in front of much more text is not the page's article
    page = f"<article><p>{' '.join(words)}</p></article><div><p>{' '.join('text%d' % i for i in range(500))}</p></div>"
    assert html_text.main_text(page, weights).endswith("text499")
    assert html_text.main_text("<article><div class='header'><h2>Head line</h2></div><p>" + " ".join(words) + "</p></article>", weights).startswith("Head line")


def test_routing_lists_only_chunks_that_are_asked_for():
    rng = np.random.default_rng(1)
    cells, chunks = 1024, 30_000
    parts = rng.integers(1, 60, cells)
    first = (np.cumsum(parts) - parts) % (chunks - 60)
    asks = rng.random((voronoi.ROUTED, cells)) < 0.01
    r, c = voronoi.chunks_of(asks, first, parts)
    want = {(q, int(first[k]) + j) for q, k in zip(*np.nonzero(asks)) for j in range(parts[k])}
    assert set(zip(r.tolist(), c.tolist())) == want and len(r) == len(want) and (np.diff(r) >= 0).all()


def test_vectors_beyond_a_double_s_squares_are_refused_by_name(spark):
    rows = [(i, [float(i), 1.0]) for i in range(100)]
    bad = spark.createDataFrame([*rows, (777, [1e307, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vec_id 777"):
        voronoi.top_k(bad, F.col("vec_id") % 50 == 0).collect()
    fine = spark.createDataFrame([*rows, (777, [float("inf"), 0.0]), (778, [1e307, None])], "vec_id long, embedding array<double>")
    assert voronoi.top_k(fine, F.col("vec_id") % 50 == 0).count() == 10  # these take no part


def test_rows_that_repeat_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "CHUNK", 100)
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") >= 1500, F.col("id") % 3).otherwise(0).cast("double")).alias("embedding"))
    from shorefall.scratch import Scratch

    placed, _, _ = voronoi.route(rows, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", Scratch(spark))
    assert placed.groupBy("chunk").count().agg(F.max("count")).first()[0] < 300
    got = voronoi.top_k(rows, F.col("vec_id") == 1500, 5).collect()
    assert len(got) == 5


def test_chunk_table_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(spchunks, "TABLE", 50)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        table = spchunks.ChunkTable(f.read())
    encoded = []
    encode = table.sp.encode
    table.sp = type("Counting", (), {"encode": lambda self, new, **kw: encoded.extend(new if isinstance(new, list) else [new]) or encode(new, **kw), "decode": staticmethod(table.sp.decode)})()
    rng = random.Random(1)
    for k in range(30):
        texts = [" ".join(["often", "again", *(f"x{rng.randrange(10**6)}" for _ in range(20))]) + "\nline" for _ in range(2)]
        for text, (n, ids, decoded) in zip(texts, table.look_up(texts)):
            want = encode(text)
            assert (n, ids) == (len(want), ",".join(map(str, want))) and decoded == text
        assert len(table.table.young) + len(table.table.old) <= 150
    assert encoded.count("often") == 1 and encoded.count("again") == 1


def test_blocks_of_items_are_passed_one_after_the_other(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 30])))) for i in range(60)]
    docs = [(i, " ".join([*(word() for _ in range(30)), *items[i % 60][1].split(), *(word() for _ in range(30))]) if i % 3 else None) for i in range(90)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.report(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", sum(len(t) for _, t in items) // 6 + 1)
    made = decontam.report(d, b)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the last block's automaton, and the number of words
    assert sorted(map(tuple, made.collect())) == whole and any(r[-1] for r in whole)
