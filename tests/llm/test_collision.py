"""Nearest neighbours by collision counting against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.llm import collision


def brute(ids, x, asks, top):
    """(query, [(id, score)...]) by comparing everything with everything."""
    out = {}
    for i in np.flatnonzero(asks):
        score = x.astype(np.float64) @ x[i].astype(np.float64)
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got, want, top):
    rows = {}
    for r in got:
        rows.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(rows) == set(want)
    hits = total = 0
    for q, found in rows.items():
        assert sorted(found) == list(range(1, len(found) + 1)) and len({i for i, _ in found.values()}) == len(found) == len(want[q])
        order = [(-round(s, 12), i) for _, (i, s) in sorted(found.items())]
        assert order == sorted(order)
        hits += len({i for i, _ in found.values()} & {i for i, _ in want[q]})
        total += len(want[q])
    return hits / total


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    got = collision.query(spark, sf_dir).collect()
    want = brute(ids, x, ids % 20 == 0, 20)
    assert recall(got, want, 20) >= 0.95
    at = {int(i): v.astype(np.float64) for i, v in zip(ids, x)}
    assert all(abs(r.score - at[r.query_id] @ at[r.vec_id]) < 1e-12 for r in got)


@pytest.mark.parametrize("kind", ["clusters", "lengths", "noise"])
def test_recall_of_several_shards(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    if kind == "clusters":
        x = np.repeat(rng.standard_normal((30, 24)), 50, 0) + 0.05 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 2, (1500, 1))
    monkeypatch.setattr(collision, "PER_SHARD", 400)
    monkeypatch.setattr(collision, "QUERIES", 16)
    ids = np.arange(1500)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(5)
    got = collision.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(ids, x, ids % 20 == 0, 20), 20) >= 0.95


def test_windows_count_what_they_hold():
    """At each radius just those points were verified whose projections are within the windows often enough."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    index = collision.Arrays(x, np.arange(300))
    along = np.empty((300, index.m), np.float32)
    for k in range(index.m):
        along[index.order[k], k] = index.along[k]
    for i in range(20):
        centre = (x[i] / np.linalg.norm(x[i])) @ index.directions[:-1]
        found, radius = index.search(x[i : i + 1], 5, 1.0)[0][0], 2**-5
        while True:
            held = np.flatnonzero((np.abs(along - centre) <= collision.HALF * radius).sum(1) >= index.asked)
            if len(held) >= 5:
                best = held[np.argsort(-index.products(held, x[i]), kind="stable")][:5]
                last = index.products(best[-1:], x[i])[0]
                if np.sqrt(max(0, 2 - 2 * last / (np.linalg.norm(x[i].astype(float)) * index.length))) <= radius or len(held) == 300:
                    break
            radius *= collision.GROW
        assert len(np.intersect1d(found, best)) >= 4  # a point on the edge of a window may be rounded either way


def test_zero_slack_is_exact():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    index = collision.Arrays(x, np.arange(200))
    for i, (found, score) in enumerate(index.search(x, 200, 0.0)):
        order = np.argsort(-(x @ x[i]), kind="stable")
        assert found.tolist() == index.exact(x[i], 200)[0].tolist() == order.tolist()
        assert np.allclose(score, (x @ x[i])[order], rtol=1e-14, atol=1e-14)


def test_copies_ties_and_edges(spark):
    one, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [(i, one) for i in range(0, 60)]
    rows += [(100, [0.0, 2.0, 0.0]), (101, [0.0, 1.0, 0.5]), (120, [0.0, 3.0, 0.0]), (120, [0.0, 3.0, 0.0]), (140, [0.0, 0.0, 1.0]), (140, [0.0, 0.5, 1.0])]
    rows += [(160, None), (180, []), (200, [0.0, 0.0, 0.0]), (220, [1.0, nan, 0.0]), (240, [1.0, None, 0.0]), (260, [float("inf"), 0.0, 0.0]), (None, one), (280, [1.0, 2.0]), (281, [2.0, 1.0])]
    table = spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank string, asks int, score double").repartition(4)
    got = {}
    for r in collision.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120, 140, 280}
    assert got[0] == [(i, 1.0) for i in range(1, 21)]
    assert got[20] == [(i, 1.0) for i in range(20)] and got[40] == got[20][:20]
    assert got[100][:3] == [(120, 6.0), (101, 2.0), (140, 1.0)]
    assert got[280] == [(281, 4.0)]
    assert not {160, 180, 200, 220, 240, 260} & {i for found in got.values() for i, _ in found}
    assert 140 not in {i for i, _ in got[140]}  # its two vectors ask on their own and don't meet one another
    assert len(got[140]) == 38
    assert collision.nearest(table.limit(0)).count() == 0
    assert collision.nearest(table.filter("vec_id = 160")).count() == 0


def test_arrays_keep_their_promises():
    """By drawing: points at the radius and at twice the radius collide as often as was asked for."""
    m, asked = collision.arrays_for()
    rng = np.random.default_rng(6)
    hits = lambda d: (np.abs(rng.standard_normal((20_000, m)) * d) <= collision.HALF).sum(1) >= asked
    assert hits(1).mean() >= 1 - collision.ERROR - 0.01 and hits(collision.RATIO).mean() <= collision.FALSE + 0.01
