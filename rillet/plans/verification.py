"""Verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit, transfer, verify
from .ensembles import MEMBERS, members
from .registry import Tables, query
from .series import events_daily, supplier_daily

CASES = "samples AS (SELECT user_id AS cas, value + event_id * 1e-9 AS value, 40.0 + user_id % 7 AS obs FROM events)"


@query(f"""WITH {CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY cas ORDER BY value) AS i, count(*) OVER (PARTITION BY cas) AS n FROM samples)
SELECT cas, round(avg(abs(value - obs)) - sum((2 * i - n - 1) * value) / pow(max(n), 2), 5) AS crps, max(n) AS n FROM r GROUP BY cas""")
def crps_ensemble(t: Tables):
    m = t.events.select(F.col("user_id").alias("case"), (F.col("value") + F.col("event_id") * 1e-9).alias("value"), (40.0 + F.col("user_id") % 7).alias("obs"))
    return verify.crps_ensemble(m).select(F.col("case").alias("cas"), F.round("crps", 5).alias("crps"), "n")


@query("SELECT event_type, round(avg(pow(least(value / 200, 1.0) - CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END, 2)), 8) AS brier, count(*) AS n FROM events GROUP BY 1")
def brier_score(t: Tables):
    df = t.events.select("event_type", F.least(F.col("value") / 200, F.lit(1.0)).alias("p"), (F.col("user_id") % 3 == 0).alias("hit"))
    return verify.brier(df, ["event_type"], "p", "hit").withColumn("brier", F.round("brier", 8))


@query("""WITH p AS (SELECT event_id, 0.2 + (user_id % 5) * 0.1 AS a, 0.3 AS b, user_id % 3 AS o FROM events)
SELECT event_id, round((pow(a - CASE WHEN o <= 0 THEN 1.0 ELSE 0 END, 2) + pow(a + b - CASE WHEN o <= 1 THEN 1.0 ELSE 0 END, 2)) / 2, 8) AS rps FROM p""")
def ranked_probability_score(t: Tables):
    df = t.events.select("event_id", (0.2 + (F.col("user_id") % 5) * 0.1).alias("a"), F.lit(0.3).alias("b"), (0.5 - (F.col("user_id") % 5) * 0.1).alias("c"), (F.col("user_id") % 3).alias("o"))
    return verify.rps(df, ["a", "b", "c"], "o").select("event_id", F.round("rps", 8).alias("rps"))


BANDS = "bands AS (SELECT event_type, user_id % 4 AS lead, value AS obs, 10.0 + user_id % 5 AS p10, 35.0 + user_id % 9 AS p50, 110.0 - user_id % 11 AS p90 FROM events)"
_pin = lambda q, tau: f"greatest({tau} * (obs - {q}), ({tau} - 1) * (obs - {q}))"


@query(f"""WITH {BANDS} SELECT event_type, lead, round(avg(CASE WHEN obs BETWEEN p10 AND p90 THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN obs < p10 THEN 1.0 ELSE 0 END), 6) AS below,
round(avg(CASE WHEN obs > p90 THEN 1.0 ELSE 0 END), 6) AS above, round(avg(abs(obs - p50)), 6) AS mae, round(avg(p90 - p10), 6) AS width, round(avg(({_pin("p10", 0.1)} + {_pin("p50", 0.5)} + {_pin("p90", 0.9)}) / 3), 10) AS pinball, count(*) AS n
FROM bands GROUP BY ROLLUP (event_type, lead)""")
def pinball_coverage(t: Tables):
    u = F.col("user_id")
    df = t.events.select("event_type", (u % 4).alias("lead"), F.col("value").alias("obs"), (10.0 + u % 5).alias("p10"), (35.0 + u % 9).alias("p50"), (110.0 - u % 11).alias("p90"))
    out = verify.band_scores(df, ["event_type", "lead"])
    return out.select("event_type", "lead", *[F.round(c, 10 if c == "pinball" else 6).alias(c) for c in ("coverage", "below", "above", "mae", "width", "pinball")], "n")


@query("""WITH p AS (SELECT least(value / 100, 1.0) AS pit FROM events), c AS (SELECT least(floor(pit * 10) + 1, 10) AS bin, count(*) AS n FROM p GROUP BY 1),
a AS (SELECT CAST(r.b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 11) r(b) LEFT JOIN c ON c.bin = r.b), s AS (SELECT *, n / sum(n) OVER () AS share FROM a) SELECT bin, n, round(share, 8) AS share, round(max(abs(share - 0.1)) OVER (), 8) AS off FROM s""")
def pit_histogram(t: Tables):
    df = t.events.select(F.least(F.col("value") / 100, F.lit(1.0)).alias("pit"))
    return verify.pit_histogram(df, "pit").select("bin", "n", F.round("share", 8).alias("share"), F.round("off", 8).alias("off"))


@query(f"""WITH {MEMBERS}, m AS (SELECT key, date, avg(value) AS mean, stddev_samp(value) AS sd FROM members GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS lead, lag(mean, 1) OVER (PARTITION BY key ORDER BY date) AS obs FROM m)
SELECT lead, round(avg(abs(mean - obs)), 6) AS score, round(avg(abs(obs - 50)), 6) AS base, round(1 - avg(abs(mean - obs)) / avg(abs(obs - 50)), 6) AS skill, round(avg(sd), 6) AS spread, round(sqrt(avg(pow(mean - obs, 2))), 6) AS rmse, count(*) AS n FROM l WHERE obs IS NOT NULL GROUP BY 1""")
def skill_by_lead(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("date")
    m = members(t).groupBy("key", "date").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    led = m.withColumns({"lead": F.row_number().over(w), "obs": F.lag("mean").over(w)}).filter("obs is not null")
    out = verify.by_lead(led.withColumns({"score": F.abs(F.col("mean") - F.col("obs")), "base": F.abs(F.col("obs") - 50)}))
    return out.select(F.col("lead").cast("long").alias("lead"), *[F.round(c, 6).alias(c) for c in ("score", "base", "skill", "spread", "rmse")], "n")


@query()
def ols_multi(t: Tables):
    """Several regressors a key; least squares per key in numpy."""
    x = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"))
    return fit.ols_multi(x, ["x1", "x2", "x3"], "y", 30)


@query("""WITH s AS (SELECT l_suppkey AS key, l_extendedprice AS y, l_quantity AS x FROM lineitem) SELECT key, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept, count(*) AS n FROM s GROUP BY key HAVING count(*) >= 30""")
def ols_gram(t: Tables):
    """The same by sums in the JVM, for one regressor."""
    x = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    return x.groupBy("key").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"), F.count(F.lit(1)).alias("n")).filter("n >= 30")


@query()
def mc_fan(t: Tables):
    """Monte-Carlo fan of an autoregressive noise around each key's last value."""
    return fit.ar1_fan(events_daily(t), horizon=14, samples=500)


@query()
def gamma_response(t: Tables):
    """Transfer function: each supplier's daily mean as the response to its quantities, with a season for evaporation."""
    day = F.to_date("l_shipdate")
    season = 2 + 2 * F.sin(2 * 3.141592653589793 * F.dayofyear("date") / 365.25)
    rain = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), day.alias("date")).agg(F.sum("l_quantity").alias("rain")).withColumn("evaporation", season)
    out = transfer.transfer(supplier_daily(t), rain)
    return out.select("key", "n", *[F.round(c, 4).alias(c) for c in ("gain", "shape", "scale", "factor", "base", "alpha", "sigma", "objective", "evp", "lag_one")], "rescued")


@query()
def hindcast_persistence(t: Tables):
    """Strided origins and persistence errors by lead."""
    return fit.hindcast(events_daily(t), stride=5, horizon=7)
