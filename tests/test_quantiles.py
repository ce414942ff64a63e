"""Quantiles by counting equal percentile, and big groups don't move."""

import random

import pytest
from pyspark.sql import functions as F

from rillet.operators import quantiles

PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("bound", [0, 250])
def test_equal_to_percentile(spark, bound, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 32)
    rng = random.Random(bound)
    rows = [("big", 1, rng.gauss(0, 1)) for _ in range(700)] + [("big", 2, rng.choice([1e-300, -1e300, 1e300, 0.0, 5.0])) for _ in range(400)]
    rows += [("ties", 1, float(rng.randint(0, 3))) for _ in range(300)] + [("one", 1, 7.0)] * 90 + [(None, None, 10.0 ** rng.uniform(-200, 200)) for _ in range(200)]
    rows += [("few", 1, 1.0), ("few", 1, 2.0), ("few", 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(6)
    got = {(r.k, r.j): (r.n, r.quantiles) for r in quantiles.quantiles(df, ["k", "j"], "x", PROBS, bound).collect()}
    want = {(r.k, r.j): (r.n, r.q) for r in df.groupBy("k", "j").agg(F.count("x").alias("n"), F.percentile("x", PROBS).alias("q")).collect()}
    assert set(got) == set(want)
    for key, (n, q) in want.items():
        assert got[key][0] == n and (q is None and got[key][1] == [None] * 7 or got[key][1] == pytest.approx(q, rel=1e-12, nan_ok=True)), key


def test_rows_of_a_big_group_stay(spark):
    """What is shuffled of a million rows of one key is histograms."""
    df = spark.range(1_000_000).select((F.col("id") % 2 * 0).alias("k"), F.rand(5).alias("x"))
    got = quantiles.quantiles(df, ["k"], "x", [0.5], bound=1000).head()
    assert got.n == 1_000_000 and got.quantiles == pytest.approx(df.agg(F.percentile("x", [0.5])).head()[0])
    plan = quantiles.quantiles(df.limit(0), ["k"], "x", [0.5])
    assert plan.count() == 0
