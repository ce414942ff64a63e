"""Edge cases of the operators on small frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet import functions as fn
from rillet import functions
from rillet.operators import ensemble, extra, fit, incremental, normals, quality, resample, segments, spatial, trend, verify, windows

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
SERIES = "key int, date date, value double"


def rows(df):
    return [tuple(r) for r in df.collect()]


def series(spark, values, key=1):
    return spark.createDataFrame([(key, D(i), v) for i, v in values], SERIES)


def test_nan_is_skipped(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 3), 2.0), (1, dt.datetime(2024, 1, 1, 4), float("nan")), (1, dt.datetime(2024, 1, 2), None)], "k int, t timestamp, v double")
    assert rows(resample.daily(df, "k", "t", "v")) == [(1, D(0), 2.0)]


def test_lag_is_calendar_true(spark):
    got = {r[1]: r[3] for r in rows(windows.calendar_lags(series(spark, [(0, 1.0), (2, 3.0), (3, 4.0)]), (1,)))}
    assert got == {D(0): None, D(2): None, D(3): 3.0}


def test_rolling_needs_all_days(spark):
    got = {r[1]: r[3] for r in rows(windows.rolling_full(series(spark, [(0, 1.0), (1, 2.0), (2, 3.0), (4, 5.0)]), (3,)))}
    assert got == {D(0): None, D(1): None, D(2): 6.0, D(4): None}


def test_weibull_against_numpy(spark):
    v = np.random.default_rng(1).random(40)
    got = {r[1]: r[3] for r in rows(windows.weibull_recharge(series(spark, [(i, float(x)) for i, x in enumerate(v)]), 1.5, 4.0, 10))}
    k = fn.weibull_kernel(1.5, 4.0, 10)
    assert math.isclose(sum(k), 1)
    for i in range(40):
        want = None if i < 10 else sum(w * v[i - j] for j, w in enumerate(k, 1))
        assert (got[D(i)] is None) if want is None else math.isclose(got[D(i)], want, rel_tol=1e-9)


def test_interpolation_stops_at_long_gaps(spark):
    g = resample.grid(series(spark, [(0, 0.0), (4, 8.0), (10, 2.0)]))
    got = {r[1]: r[3] for r in rows(segments.interpolate(g, 3))}
    assert got[D(1)] == 2.0 and got[D(3)] == 6.0 and got[D(5)] is None and got[D(7)] == 5.0


@pytest.mark.parametrize("level,want", [(1.0, 2.0), (10.0, 10.0), (15.0, 10 + (100 / 3 - 10) / 2), (30.0, 50.0), (50.0, 90.0), (51.0, 98.0)])
def test_ladder(spark, level, want):
    c = [F.lit(float(x)) for x in (10, 20, 30, 40, 50)]
    assert math.isclose(spark.range(1).select(fn.ladder_percentile(F.lit(level), *c)).head()[0], want)


def test_ladder_refuses_falling(spark):
    c = [F.lit(float(x)) for x in (10, 20, 15, 40, 50)]
    assert spark.range(1).select(fn.ladder_percentile(F.lit(12.0), *c)).head()[0] is None


def test_status_bounds_are_near(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert [r[0] for r in v.select(fn.status(F.col("v"), F.lit(2.0), F.lit(3.0))).collect()] == ["below", "near", "near", "above", None]


def test_phi(spark):
    from statistics import NormalDist

    x = spark.createDataFrame([(i / 10,) for i in range(-40, 41)], "x double")
    assert all(abs(p - NormalDist().cdf(v)) < 1e-7 for v, p in rows(x.select("x", fn.normal_cdf(F.col("x")))))


def test_crps_gaussian_is_least_at_the_mean(spark):
    df = spark.range(1).select(*[fn.crps_gaussian(F.lit(0.0), F.lit(1.0), F.lit(y)) for y in (0.0, 1.0, 3.0)])
    a, b, c = df.head()
    assert math.isclose(a, 0.23369, abs_tol=1e-4) and a < b < c


def test_fence_without_spread_keeps_all(spark):
    df = spark.createDataFrame([(1, 5.0)] * 5 + [(2, float(x)) for x in (1, 2, 3, 4, 1000)], "k int, v double")
    got = rows(quality.iqr_fence(df, "k", "v", 3.0))
    assert got.count((1, 5.0)) == 5 and (2, None) in got and (2, 1000.0) not in got


def test_within_equals_brute_force(spark):
    r = np.random.default_rng(2)
    pts = [(i, float(50 + x), float(-3 + y)) for i, (x, y) in enumerate(r.random((80, 2)))]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in pts for b in pts if km(a, b) <= 15}
    assert {(a, b) for a, b, _ in rows(spatial.within(df, df, 15.0))} == want
    near = {(a[0], b[0]) for a in pts for b in sorted(pts, key=lambda b: (km(a, b), b[0]))[:3]}
    for most in (1000, 10):  # by broadcast, and by growing rings of cells
        assert {(a, b) for a, b, *_ in rows(spatial.nearest(df, df, 3, most))} == near


def test_polygon_with_hole(spark):
    rings = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0)], "lon double, lat double")
    assert [r[0] for r in df.select(fn.in_polygon(F.col("lon"), F.col("lat"), rings)).collect()] == [True, False, False]


def test_breach_counts_members_that_never_cross(spark):
    m = [(1, k, D(d), 10.0 if k < 2 and d >= 2 + k else 0.0, 5.0) for k in range(4) for d in range(20)]
    r = ensemble.breach(spark.createDataFrame(m, "key int, member int, date date, value double, threshold double")).head()
    assert (r.horizon, r.members, r.p_breach, r.p_breach_window, r.censored, r.median_lead, r.cross_median) == (20, 4, 0.5, 0.5, 0.5, 3.5, D(3))


def test_crps_ensemble_against_pairs(spark):
    v = np.random.default_rng(3).random(9)
    got = verify.crps_ensemble(spark.createDataFrame([(1, float(x), 0.4) for x in v], "case int, value double, obs double")).head().crps
    want = np.abs(v - 0.4).mean() - np.abs(v[:, None] - v[None]).mean() / 2
    assert math.isclose(got, want, rel_tol=1e-9)


def test_theil_sen_shrugs_off_an_outlier(spark):
    s = spark.createDataFrame([(1, dt.date(2020 + i // 12, i % 12 + 1, 1), float(i) if i != 7 else 999.0) for i in range(36)], "key int, month date, value double")
    assert abs(trend.theil_sen(s).head().slope - 12) < 0.2


def test_precedence(spark):
    df = spark.createDataFrame([(1, "live", 3, 9.0), (1, "audited", 1, 5.0), (2, "live", 1, 1.0), (2, "live", 2, 2.0)], "k int, src string, at int, v double")
    got = rows(incremental.precedence(df, ["k"], F.when(F.col("src") == "audited", 0).otherwise(1), F.col("at")).select("k", "v").orderBy("k"))
    assert got == [(1, 5.0), (2, 2.0)]


def test_normals_leave_out_the_open_month(spark):
    s = spark.createDataFrame([(1, dt.date(y, 1, 5), float(y)) for y in range(2015, 2022)], "key int, date date, value double")
    got = normals.monthly_normals(s, F.lit("2021-01-20").cast("date")).head()
    assert got.years == 6 and got.median == 2017.5


def test_empty_tables(spark):
    e = spark.createDataFrame([], SERIES)
    for df in (windows.calendar_lags(e), windows.rolling_full(e), resample.grid(e), segments.interpolate(e), windows.noise(e), incremental.missing_ranges(e), trend.theil_sen(resample.monthly(e)), windows.recurrence(e, 0.5, 0.5)):
        assert df.collect() == []


def test_ols_multi(spark):
    r = np.random.default_rng(4)
    x = r.random((60, 2))
    df = spark.createDataFrame([(1, float(a), float(b), float(2 + 3 * a - b)) for a, b in x], "key long, x1 double, x2 double, y double")
    got = fit.ols_multi(df, ["x1", "x2"], "y", 30).head()
    assert np.allclose(got.coefficients, [2, 3, -1], atol=1e-6) and got.r2 > 0.999999


def test_ar1_fan_spreads_and_repeats(spark):
    s = series(spark, [(i, math.sin(i) + i % 3) for i in range(60)])
    a, b = (sorted(rows(fit.ar1_fan(s, 10, 400))) for _ in range(2))
    assert a == b and all(p10 <= p50 <= p90 for _, _, p10, p50, p90, *_ in a)


def test_national_grid(spark):
    from rillet.functions import geodesy

    # The guide's worked example, on the grid's own ellipsoid, and a landmark by its published coordinates.
    lat, lon = math.radians(52 + 39 / 60 + 27.2531 / 3600), math.radians(1 + 43 / 60 + 4.5177 / 3600)
    e, n = spark.range(1).select(*geodesy.project(F.lit(lat), F.lit(lon))).head()
    assert abs(e - 651409.903) < 0.01 and abs(n - 313177.270) < 0.01
    e, n = spark.range(1).select(*geodesy.to_grid(F.lit(51.4778), F.lit(-0.0014))).head()
    assert abs(e - 538_880) < 60 and abs(n - 177_320) < 60


def test_ensemble_source(spark):
    from rillet.sources.provider import EnsembleSource

    spark.dataSource.register(EnsembleSource)
    read = lambda: spark.read.format("ensemble").options(start="2024-01-01", horizon="5", places="51.5,-1.2;52.0,0.1").load()
    assert read().count() == 2 * 8 * 5 and sorted(map(tuple, read().collect())) == sorted(map(tuple, read().collect()))


def test_places_in_order(spark, sf_dir):
    from rillet import plans

    x = [(i, None if i % 7 == 0 else i * 37 % 11) for i in range(300)]
    df = spark.createDataFrame(x, "id int, x int").repartition(5)
    got = {r.id: r.place for r in windows.places_in_order(df, [F.col("x").desc_nulls_last(), F.col("id")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(x, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    assert windows.places_in_order(df.limit(0), [F.col("id")]).count() == 0
    for name, table, key in (("triage_order", "orders", "o_custkey"), ("nulls_last_order", "part", "p_partkey")):
        assert plans.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()


def test_similar_names_against_all_pairs(spark, monkeypatch):
    import difflib
    import random

    from rillet.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 40, raising=False)
    rng = random.Random(5)
    words = [f"{w} brook" for w in ("smith", "upper hallow", "long marston", "kings norton", "aaaaaaaaaaaaaaaaaaaaaa mill")] + [f"customer {n:09d}" for n in (700000, 123456789)]

    def typo(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", "e", "y", "7", s[i] + "x"]) + s[i + 1 :]
        return s

    left = ["smyth brook", "customer#000700000", None, ""] + [typo(rng.choice(words)) for _ in range(110)]
    right = ["smith brook", "customer 700000", None, ""] + [typo(rng.choice(words)) for _ in range(90)]
    frame = lambda names, at: spark.createDataFrame([(i, s, at, at, -i - int(at)) for i, s in enumerate(names)], "id int, name string, lat double, lon double, ref int")
    got = {r.a: (r.b, r.tier, round(r.score, 9)) for r in matching.cascade(frame(left, 10.0), frame(right, 40.0).withColumn("ref", F.lit(1))).collect()}
    norm = lambda s: " ".join(sorted("".join(c if c.isalnum() else " " for c in s.lower()).split()))
    want = {}
    for i, s in enumerate(left):
        if s is not None:
            alike = [(3 if norm(s) == norm(u) else 4, -round(difflib.SequenceMatcher(None, norm(s), norm(u)).ratio(), 9), j) for j, u in enumerate(right) if u is not None]
            tier, score, j = min(x for x in alike if x[0] == 3 or x[1] <= -0.9) if any(x[0] == 3 or x[1] <= -0.9 for x in alike) else (0, 0, 0)
            if tier:
                want[i] = (j, tier, -score)
    assert {i: (got.get(i), want.get(i)) for i in got.keys() | want.keys() if got.get(i) != want.get(i)} == {}
    assert got[0][1] == 4 and got[1][1] in (3, 4) and len({t for _, t, _ in got.values()}) == 2


def test_trace_weights_of_all_rows(spark, sf_dir):
    from rillet import plans

    traces = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.year("l_shipdate")).distinct().count()
    assert plans.queries()["trace_weights_months"](spark, sf_dir).count() == traces


def test_neighbour_overlap_beyond_next_keys(spark, sf_dir):
    from rillet import plans

    # Ten suppliers have no such neighbours; a hundred do.
    assert plans.queries()["neighbour_overlap"](spark, sf_dir.replace("sf0.001", "sf0.01")).filter("b > a + 2").count() > 0


def test_within_meets_all_pairs_anywhere(spark):
    """Poles, the turn of longitude and the whole globe against all pairs."""
    rng = np.random.default_rng(5)
    lat = np.r_[rng.uniform(-90, 90, 150), rng.uniform(80, 90, 60), [90.0, -90.0, 89.999], rng.uniform(-5, 5, 60)]
    lon = np.r_[rng.uniform(-180, 180, 210), [0.0, 10.0, -170.0], rng.choice([-1, 1], 60) * rng.uniform(179, 180, 60)]
    d = spark.createDataFrame([*((i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))), (999, None, 1.0)], "id long, lat double, lon double")
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))
    for bound in (25.0, 300.0, 4000.0):
        got = sorted((r.a, r.b) for r in spatial.within(d, d, bound).collect())
        assert got == sorted(zip(*(x.tolist() for x in np.nonzero(km <= bound)))), bound


def test_longest_path_with_cycles(spark):
    edges = [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 2, 5.0), (1, 3, 4, 2.0), (2, 7, 8, 1.0), (2, 8, 7, 1.0), (3, 1, 2, 4.0), (3, 1, 3, 1.0), (3, 3, 2, 1.0)]
    got = {r.group: (r.nodes, r.length) for r in extra.longest_path(spark.createDataFrame(edges, "group long, a long, b long, length double")).collect()}
    assert got == {1: ([1, 2, 3, 4], 4.0), 2: ([7, 8], 1.0), 3: ([1, 2], 4.0)}


def test_rings_of_many_edges(spark):
    turn = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    ring = [(float(x), float(y)) for x, y in zip(np.cos(turn) * (1 + 0.3 * np.sin(9 * turn)), np.sin(turn) * (1 + 0.3 * np.sin(9 * turn)))]
    rng = np.random.default_rng(6)
    pts = rng.uniform(-1.4, 1.4, (400, 2))
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, lon double, lat double")
    got = {r.id for r in d.filter(functions.in_ring(F.col("lon"), F.col("lat"), ring)).collect()}
    angle = np.arctan2(pts[:, 1], pts[:, 0])
    inside = np.hypot(*pts.T) < 1 + 0.3 * np.sin(9 * angle)
    assert len(got ^ set(np.flatnonzero(inside).tolist())) <= 2 and 50 < len(got) < 350
