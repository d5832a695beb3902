import numpy as np
import pytest
from pyspark.sql import functions as F

from shorefall.functions import percentile


@pytest.mark.parametrize("bits", [11, 3])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_exact_percentiles(spark, monkeypatch, bits, kind):
    monkeypatch.setattr(percentile, "BITS", bits)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 500):
        v = rng.integers(-20, 50, n).astype(float)
        df = spark.createDataFrame([(float(x), None) for x in v] + [(None, None)], f"a {kind}, b {kind}")
        qs = (0.0, 0.5, 0.9, 0.95, 1.0)
        got = percentile.exact_percentiles(df, [F.col("a")] * len(qs) + [F.col("b")], [*qs, 0.5])
        assert got[:-1] == pytest.approx([np.percentile(v, 100 * q) for q in qs]) and got[-1] is None


def test_same_as_the_plain_aggregate(spark):
    rng = np.random.default_rng(2)
    spread = np.concatenate([rng.normal(size=1500), rng.normal(size=400) * 1e-300, rng.normal(size=100) * 1e300, [0.0, -0.0, np.inf, -np.inf]])
    ties = np.repeat([1.0, 2.0, 7.0, -1.0], [900, 1000, 100, 4])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(spread, ties)], "a double, b double").withColumn("c", F.col("b").cast("float"))
    for q in (0.001, 0.45, 0.5, 0.75, 0.95, 0.999):
        want = list(df.agg(*[F.percentile(c, q) for c in "abc"]).first())
        assert percentile.exact_percentiles(df, [F.col(c) for c in "abc"], q) == want
    assert percentile.exact_percentiles(df.limit(0), [F.col("a")], 0.5) == [None]
    assert percentile.exact_percentiles(df, [], 0.5) == []


def test_number_of_passes_is_fixed(spark, monkeypatch):
    passes = []
    counts = percentile._counts
    monkeypatch.setattr(percentile, "_counts", lambda *a: passes.append(1) or counts(*a))
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(3000)], "a float, b float").repartition(4)
    percentile.exact_percentiles(df, [F.col("a"), F.col("b")] * 9, 0.9)
    assert len(passes) == 3


def test_bits_order_as_values_do():
    for kind, width in ((np.float32, 32), (np.float64, 64)):
        v = np.array([-np.inf, -1e30, -2.5, -1.0, -1e-40, 0.0, 1e-40, 1.0, 3.0, np.inf, np.nan], kind)
        u = percentile.ordered_bits(v)
        assert (np.diff(u.astype(object)) > 0).all()
        assert [percentile.from_bits(int(x), width) for x in u[:-1]] == v[:-1].tolist()
        assert percentile.ordered_bits(np.array([-0.0], kind)) == percentile.ordered_bits(np.array([0.0], kind))
