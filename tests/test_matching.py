"""Similar names by the prefix filter against all pairs."""

import difflib
import random

import pytest

from rillet.operators import matching


@pytest.mark.parametrize("ratio", [0.5, 0.75, 0.82, 0.9])
def test_no_pair_is_lost(spark, ratio):
    rng = random.Random(int(100 * ratio))
    name = lambda: "".join(rng.choice("aabc d") for _ in range(rng.randint(0, 9)))
    base = [name() * rng.randint(1, 3) for _ in range(60)]
    left, right = ([rng.choice(base)[rng.randint(0, 2) :] + rng.choice(["", "", "a", "xa"]) for _ in range(90)] for _ in range(2))
    l = spark.createDataFrame([(n,) for n in left] + [(None,)], "norm string")
    r = spark.createDataFrame([(n, k) for k, n in enumerate(right)] + [(None, 1), ("aab", None)], "norm string, b int")
    got = {x.norm: (x.b, round(x.s, 9)) for x in matching.similar(l, r, ratio).collect()}
    names = {}
    for k, n in [*enumerate(right), (None, "aab")]:
        if n:
            names.setdefault(n, []).append(k)
    want = {}
    for n in filter(None, set(left)):
        alike = []
        for o, ks in names.items():
            if (s := difflib.SequenceMatcher(None, n, o).ratio()) >= ratio:
                known = [k for k in ks if k is not None]
                alike.append((-round(s, 9), bool(known), min(known, default=-1)))
        if alike:
            s, known, b = min(alike)
            want[n] = (b if known else None, -s)
    assert got == want and len(want) > 10


def test_candidates_follow_what_is_alike(spark):
    """Ten times the names, half of which are on both sides: ten times the candidates, far from all pairs."""
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(18)) for _ in range(4500)]
    made = lambda n, k: spark.createDataFrame([(x,) for x in names[k : k + n]], "norm string")
    few, many = (matching.candidates(made(n, 0), made(n, n // 2).selectExpr("norm", "1 AS b"), 0.9).count() for n in (300, 3000))
    assert few == 150 and many == 1500


def test_names_are_compared_for_rows_that_nothing_else_matches(spark, monkeypatch):
    asked = []
    whole = matching.similar
    monkeypatch.setattr(matching, "similar", lambda l, r, ratio: asked.extend(x.id for x in l.collect()) or whole(l, r, ratio))
    kind = "id long, name string, lat double, lon double, ref long"
    left = spark.createDataFrame([(1, "abcdefghij one", 50.0, 1.0, 7), (2, "abcdefghij one", 51.0, 1.0, None), (3, "River Long Head", 55.0, 1.0, None), (4, "abcdefghij onx", 56.0, 1.0, None), (5, "zz", None, None, None)], kind)
    right = spark.createDataFrame([(10, "abcdefghij one", 60.0, 1.0, 7), (9, "other", 62.0, 1.0, 7), (11, "quite other", 51.0, 1.0, None), (8, "quite other", 51.0, 1.0, None), (12, "head long river", 61.0, 1.0, None)], kind)
    got = sorted((r.a, r.b, r.tier, round(r.score, 6)) for r in matching.cascade(left, right).collect())
    assert got == [(1, 9, 1, 1.0), (2, 8, 2, 1.0), (3, 12, 3, 1.0), (4, 10, 4, round(13 * 2 / 28, 6))] and sorted(asked) == [4, 5]
