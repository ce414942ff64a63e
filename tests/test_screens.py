"""Screens, rolls and sampled futures against plain numpy and by hand."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.functions import documents, units
from rillet.operators import montecarlo, records, rolls, screens

DAY = datetime.date(2020, 1, 1)


def daily(spark, by_key, extra=""):
    rows = [(k, DAY + datetime.timedelta(i), *(v if isinstance(v, tuple) else (v,))) for k, vs in by_key.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, f"key long, date date, value double{extra}")


def test_short_and_constant_series_are_examined_no_further(spark):
    d = daily(spark, {1: [(0.5, 1.0)] * 70, 2: [(float(i % 3), float(i)) for i in range(20)], 3: [(float((-1) ** i * i), float(i)) for i in range(80)]}, ", level double")
    got = {r.key: r for r in screens.residual_diagnostics(d).collect()}
    assert (got[1].flags, got[1].passes, got[1].lag1) == ("ok", True, None) and (got[2].flags, got[2].passes, got[2].n) == ("insufficient_obs", True, 20)
    assert "autocorrelated_noise" in got[3].flags and "heteroscedastic" in got[3].flags and not got[3].passes


def test_innovation_sd_looks_back_from_the_origin(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=300)).tolist()
    x[150] = None
    d = daily(spark, {1: x})
    origins = [DAY + datetime.timedelta(k) for k in (5, 100, 170, 299, 400)]
    got = {r.origin: r.sd for r in screens.innovation_sd(d, spark.createDataFrame([(1, o) for o in origins], "key long, origin date")).collect()}
    for o in origins:
        end = (o - DAY).days
        window = {i: x[i] for i in range(max(0, end - 89), min(299, end) + 1) if x[i] is not None}
        diffs = np.array([window[i] - window[i - 1] for i in window if i - 1 in window])
        want = 1.4826 * np.median(np.abs(diffs - np.median(diffs))) if len(diffs) >= 10 else 0.0
        assert abs(got[o] - want) < 1e-9, o


def history(spark, n=200):
    rng = np.random.default_rng(2)
    level, change, rows = 5.0, 0.0, []
    for i in range(n):
        rain, turn = float(rng.gamma(1.0)), 2 * np.pi * i / 365.25
        change = 0.3 - 0.06 * level + 0.05 * rain + 0.3 * change + 0.02 * np.sin(turn) + 0.01 * rng.normal()
        level += change
        rows.append((1, DAY + datetime.timedelta(i), float(level), rain, float(np.sin(turn)), float(np.cos(turn))))
    return rows, spark.createDataFrame(rows, "key long, date date, value double, recharge double, season_sin double, season_cos double")


def test_fit_and_roll_as_least_squares_says(spark):
    rows, d = history(spark)
    x, r, s, c = (np.array([row[i] for row in rows]) for i in (2, 3, 4, 5))
    dx = np.diff(x)
    for method in rolls.LEAST:
        at = slice(0, None) if method == "reduced" else slice(1, None)
        y, before, rain, sn, cs = dx[at], x[:-1][at], r[1:][at], s[1:][at], c[1:][at]
        last = np.r_[np.nan, dx[:-1]][at]
        center = before.mean()
        xs = {"reduced": [before, rain, sn, cs], "momentum": [before, rain, last, rain**2, sn, cs], "gated": [before - center, (before - center) * rain, rain, last, rain**2, sn, cs]}[method]
        want = np.linalg.lstsq(np.stack([np.ones(len(y)), *xs], 1), y, rcond=None)[0]
        p = rolls.fit(d, method).head()
        assert np.allclose(p.coefficients, want, atol=1e-6) and abs(p.center - center) < 1e-9
        assert np.allclose((p.lo_change, p.hi_change), np.quantile(dx, (0.01, 0.99))) and np.allclose((p.lo, p.hi), (x.min() - 0.1 * np.ptp(x), x.max() + 0.1 * np.ptp(x)))
    still = rolls.fit(d.filter(F.col("date") < F.lit(DAY + datetime.timedelta(20))), "gated").head()
    assert still.coefficients == [0.0] * 8


def test_backtest_learns_nothing_from_after_the_origin(spark):
    rows, d = history(spark)
    origin = DAY + datetime.timedelta(150)
    later = F.col("date") > F.lit(origin + datetime.timedelta(5))
    origins = spark.createDataFrame([(1, origin)], "key long, origin date")
    one, other = (sorted((r.lead, round(r.error + v, 9)) for r, v in ((r, 0) for r in rolls.backtest(h, "momentum", origins, 5).collect())) for h in (d, d.withColumn("value", F.when(later, F.col("value") + 100).otherwise(F.col("value")))))
    assert one == other and [x[0] for x in one] == [1, 2, 3, 4, 5]
    told = rolls.gate(rolls.backtest(d, "momentum", spark.createDataFrame([(1, DAY + datetime.timedelta(k)) for k in (120, 140, 160)], "key long, origin date"), 10)).head()
    assert told.origins == 3 and told.passes and told.skill > 0.3


def test_noise_has_its_marginals_and_hangs_together():
    sd = np.sqrt(1 - np.exp(-2 * np.arange(1, 31) / 20))
    z = montecarlo.noise_paths(40_000, sd, float(np.exp(-1 / 20)), np.random.default_rng(0))
    assert np.allclose(z.std(0), sd, rtol=0.03)
    assert abs(np.corrcoef(z[:, 20], z[:, 21])[0, 1] - np.exp(-1 / 20) * sd[20] / sd[21]) < 0.02


def test_sampled_breach(spark):
    m = daily(spark, {1: [5.0] * 10, 2: [5.0] * 10, 3: [5.0] * 10}).withColumns({"member": F.lit(0), "sd": F.lit(1.0)})
    bounds = spark.createDataFrame([(1, 6.0, 1e-9), (2, None, 5.0), (3, 5.0, 1e9)], "key long, bound double, alpha double")
    got = {r.key: r for r in montecarlo.breach(m, bounds, 20_000, window=3).collect()}
    tail = 0.158655
    assert abs(got[1].p_breach - (1 - (1 - tail) ** 10)) < 0.015 and abs(got[1].p_window - (1 - (1 - tail) ** 3)) < 0.015
    assert got[2].p_breach is None and abs(got[2].end_median - 5) < 0.05
    assert abs(got[3].p_breach - 0.5) < 0.02 and got[3].first_median == 1  # one draw for all days
    low = montecarlo.breach(m, bounds, 20_000, below=True, window=3).filter("key = 3").head()
    assert abs(low.p_breach + got[3].p_breach - 1) < 0.03


def test_monthly_outlook_weighs_traces(spark):
    rows = [(1, t, DAY, float(t)) for t in range(4)] + [(2, t, DAY, float(t)) for t in range(4)]
    traces = spark.createDataFrame(rows, "key long, trace long, month date, value double")
    w = spark.createDataFrame([(1, 3, 1.0), (1, 0, 0.0), (2, 0, 0.0)], "key long, trace long, weight double")
    got = {r.key: r for r in montecarlo.monthly_outlook(traces, w, spark.createDataFrame([(1, DAY, 0.0)], "key long, month date, sd double"), 4000).collect()}
    assert (got[1].p10, got[1].p90) == (3.0, 3.0) and abs(got[2].mean - 1.5) < 0.1


def test_penman_monteith_of_the_published_example(spark):
    """FAO-56, example 18: 3.9 mm a day."""
    args = dict(tmin=12.3, tmax=21.5, wind=10 / 3.6, sun=22.07, lat=50.8, day=187.0, height=100.0)
    dew = 237.3 * np.log(1.409 / 0.6108) / (17.27 - np.log(1.409 / 0.6108))
    c = {k: F.lit(v) for k, v in args.items()}
    got = spark.range(1).select(units.penman_monteith(c["tmin"], c["tmax"], F.lit(float(dew)), c["wind"], c["sun"], c["lat"], c["day"], c["height"]).alias("x")).head().x
    assert abs(got - 3.88) < 0.05


def test_records_edges(spark):
    empty = spark.createDataFrame([], "key long, date date, value double")
    some = daily(spark, {1: [1.0, 2.0]})
    assert records.assembled({"a": some, "b": empty}).count() == 0 and records.complete_rows({"a": some, "b": empty}).count() == 0
    one = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 1.0, 0.0), (2, 3, 2.0, 0.0), (2, 4, 2.5, 0.0)], "key long, i int, x double, y double")
    assert sorted((r.key, r.i) for r in records.path_points(one, 2.0).collect()) == [(1, 1), (2, 1), (2, 3), (2, 4)]
    bad = spark.createDataFrame([("not json",), ('{"items": [{"measure": ["a", "b"], "dateTime": "2024-01-01T00:00:00Z", "value": 1}, {"measure": "c"}]}',), (None,)], "payload string")
    assert [(r.measure, r.value) for r in records.live_readings(bad).collect()] == [("a", 1.0)]


def test_documents(spark):
    d = spark.createDataFrame([("plain", None), ('say "x", y', 1.0), (None, float("nan"))], "t string, v double")
    got = d.select(documents.csv_field(F.col("t")).alias("c"), documents.json_number(F.col("v"), 1).alias("n"), documents.json_flag(F.col("v")).alias("f"), documents.visible("all", F.col("t"), F.lit(None).cast("boolean")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("plain", None, False, True), ('"say ""x"", y"', 1.0, True, True), ("", None, False, True)]


def test_sampled_breach_is_spread_and_keeps_whole_days(spark):
    m = daily(spark, {1: [5.0] * 10}).withColumns({"member": F.lit(0), "sd": F.lit(1.0)})
    two = m.unionByName(m.withColumns({"member": F.lit(1), "value": F.lit(5.0)}).orderBy("date").limit(7))
    out = montecarlo.breach(two, spark.createDataFrame([(1, 6.0, 5.0)], "key long, bound double, alpha double"), 100)
    assert out.head().days == 7 and "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="a day twice"):
        montecarlo.breach(m.union(m), spark.createDataFrame([(1, 6.0, 5.0)], "key long, bound double, alpha double"), 100).collect()
