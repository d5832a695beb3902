import random

import pytest

from shorefall.graph import connected_components
from shorefall.scratch import Scratch


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],  # a path in order
    [(0, i) for i in range(1, 50)] + [(100, 101)],  # a hub
    [(random.Random(5).randrange(90), i) for i in range(90)],
    [(-(2**63), 2**63 - 1), (7, 7), (3, 4), (4, 3)],
    [],
])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()}
    assert got == brute([(a, b) for a, b in edges if a != b])
