"""Long chunks: state maps of pieces made apart, composed, and held against the library."""

from __future__ import annotations

import random
import time

import pytest
import sentencepiece

import public_tokenizers as P
from shorefall.llm import transducer

PIECES = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def own():
    with open(PIECES, "rb") as f:
        return transducer.Transducer(f.read())


def unbroken(rng, n, kind):
    """A text without blanks."""
    if kind == "one letter":
        return "a" * n
    if kind == "periodic":
        unit = "".join(rng.choice("abcdeins") for _ in range(rng.randint(2, 7)))
        return (unit * (n // len(unit) + 1))[:n]
    if kind == "han":
        return "".join(chr(rng.randrange(0x4E00, 0x4E80)) for _ in range(n))
    if kind == "code":
        return "".join(rng.choice(["function(", "){return ", "var ", "this.", "x=", "0x1f", ";", "prototype", "==="]).replace(" ", "_") for _ in range(n // 5))[:n]
    return "".join(rng.choice("etaoinshrdlué\U0001f600\x00.") for _ in range(n))


@pytest.mark.parametrize("kind", ["one letter", "periodic", "han", "code", "letters"])
@pytest.mark.parametrize("piece, ahead, starts", [(40, 20, 4), (64, 3, 1), (7, 5, 2)])
def test_pieces_of_long_chunks_agree_with_the_library(monkeypatch, kind, piece, ahead, starts):
    for name, value in (("PIECE", piece), ("AHEAD", ahead), ("STARTS", starts)):
        monkeypatch.setattr(transducer, name, value)
    t, rng = own(), random.Random(3)
    texts = [unbroken(rng, n, kind) for n in (piece - 1, piece, piece + 1, 5 * piece + 3, 700)]
    texts += [f"{a} {b}\n{c}" for a, b, c in zip(texts, texts[1:], texts[2:])]
    assert t.count(texts).tolist() == [len(x) for x in LIB.encode(texts)]


def test_state_maps_compose_to_the_map_of_the_whole(monkeypatch):
    monkeypatch.setattr(transducer, "PIECE", 50)
    monkeypatch.setattr(transducer, "AHEAD", 30)
    t, rng = own(), random.Random(4)
    for kind in ("one letter", "periodic", "letters", "code"):
        text = unbroken(rng, 1000, kind)
        maps = [t.state_map(text, a) for a in range(0, len(text), 50)]
        for i, prefix in enumerate(transducer.scanned(maps)):
            if transducer.START in prefix:
                to, n = t.read(text[: 50 * (i + 1)], 0)
                assert prefix[transducer.START] == (t.keys[to], n)
        # every entry state leads where reading from it leads
        for a, m in zip(range(0, len(text), 50), maps):
            for key, (out, n) in m.items():
                to, more = t.read(text[a : a + 50], t.state(key))
                assert (t.keys[to], more) == (out, n)
        left, right = transducer.composed(transducer.composed(maps[1], maps[2]), maps[3]), transducer.composed(maps[1], transducer.composed(maps[2], maps[3]))
        assert left == right


def test_what_is_kept_stays_bounded(monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 2000)
    monkeypatch.setattr(transducer, "PIECE", 200)
    t, rng = own(), random.Random(5)
    texts = [unbroken(rng, 4000, "letters") for _ in range(4)]
    assert t.count(texts).tolist() == [len(x) for x in LIB.encode(texts)]
    assert len(t.fits) < 60_000 and len(t.keys) < 20_000


def test_five_megabytes_without_a_blank():
    text = unbroken(random.Random(6), 2_500_000, "code") + unbroken(random.Random(7), 850_000, "han")
    assert len(text.encode()) > 5_000_000
    began = time.perf_counter()
    assert own().count([text]).tolist() == [len(LIB.encode(text))]
    assert time.perf_counter() - began < 120
