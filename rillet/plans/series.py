"""Time series queries: resampling, features, quality, normals, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import effective_rain, season_day, seasonality, water_year, weibull_kernel
from ..operators import normals, quality, resample, segments, trend, windows
from .registry import Tables, query


def events_daily(t: Tables):
    return resample.daily(t.events, "user_id", "ts", "value")


def supplier_daily(t: Tables, how: str = "avg"):
    return resample.daily(t.lineitem, "l_suppkey", "l_shipdate", "l_extendedprice", how)


def supplier_monthly(t: Tables):
    return resample.monthly(supplier_daily(t))


EVENTS_DAILY = "daily AS (SELECT user_id AS key, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY 1, 2)"
GRID = f"""{EVENTS_DAILY}, span AS (SELECT key, min(date) AS a, max(date) AS b FROM daily GROUP BY key),
grid AS (SELECT s.key, CAST(s.d AS DATE) AS date, daily.value FROM (SELECT key, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span) s LEFT JOIN daily ON daily.key = s.key AND daily.date = s.d)"""
SUPPLIER_DAILY = "daily AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
MONTHLY = f"{SUPPLIER_DAILY}, monthly AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, avg(value) AS value FROM daily GROUP BY 1, 2)"


@query("SELECT user_id AS key, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def daily_resample_mean(t: Tables):
    return events_daily(t).withColumn("value", F.round("value", 6))


@query("SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS date, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2")
def daily_resample_sum(t: Tables):
    return resample.daily(t.lineitem, "l_suppkey", "l_shipdate", "l_quantity", "sum").withColumn("value", F.round("value", 4))


@query("SELECT event_type AS key, CAST(date_trunc('hour', ts) AS VARCHAR) AS at, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY 1, 2")
def hourly_multi_agg(t: Tables):
    return resample.multi(t.events, "event_type", "ts", "value").select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", "n")


_lag = lambda n: f"(SELECT b.value FROM daily b WHERE b.key = a.key AND b.date = a.date - {n})"


@query(f"WITH {EVENTS_DAILY} SELECT key, date, round({_lag(1)}, 6) AS lag_1, round({_lag(7)}, 6) AS lag_7 FROM daily a")
def calendar_lag_features(t: Tables):
    return windows.calendar_lags(events_daily(t), (1, 7)).select("key", "date", F.round("lag_1", 6).alias("lag_1"), F.round("lag_7", 6).alias("lag_7"))


_roll = lambda n: f"CASE WHEN count(value) OVER w{n} = {n} THEN round(sum(value) OVER w{n}, 6) END AS sum_{n}"
_win = lambda n: f"w{n} AS (PARTITION BY key ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"


@query(f"WITH {EVENTS_DAILY} SELECT key, date, {_roll(3)}, {_roll(7)} FROM daily WINDOW {_win(3)}, {_win(7)}")
def rolling_full_window(t: Tables):
    return windows.rolling_full(events_daily(t)).select("key", "date", F.round("sum_3", 6).alias("sum_3"), F.round("sum_7", 6).alias("sum_7"))


_kernel = ", ".join(f"({i}, {w!r})" for i, w in enumerate(weibull_kernel(1.5, 4.0, 10), 1))


@query(f"""WITH {GRID}, kernel(i, w) AS (VALUES {_kernel}), numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS n FROM grid)
SELECT a.key, a.date, CASE WHEN max(a.n) > 10 AND count(b.value) >= 0.8 * 10 THEN round(sum(coalesce(b.value, 0) * w), 6) END AS recharge
FROM numbered a LEFT JOIN kernel ON true LEFT JOIN numbered b ON b.key = a.key AND b.date = a.date - CAST(i AS INTEGER) GROUP BY a.key, a.date""")
def weibull_recharge(t: Tables):
    return windows.weibull_recharge(resample.grid(events_daily(t)), 1.5, 4.0, 10, 0.8).select("key", "date", F.round("recharge", 6).alias("recharge"))


@query("""WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, CASE WHEN b - a > 0 AND (value < m - 1.5 * (b - a) OR value > m + 1.5 * (b - a)) THEN NULL ELSE value END AS value FROM events JOIN q USING (user_id)""")
def iqr_fence(t: Tables):
    return quality.iqr_fence(t.events.select("event_id", "user_id", "value"), "user_id", "value", 1.5).select("event_id", "value")


@query("""WITH h AS (SELECT * FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20'), q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b, count(*) AS n FROM h GROUP BY 1)
SELECT event_id, value FROM events LEFT JOIN q USING (user_id) WHERE CAST(ts AS DATE) >= DATE '2024-01-20' AND (coalesce(n, 0) < 4 OR b - a <= 0 OR value BETWEEN m - 1.5 * (b - a) AND m + 1.5 * (b - a))""")
def tail_screen(t: Tables):
    cut = F.to_date("ts") < F.lit("2024-01-20").cast("date")
    e = t.events.select("event_id", "user_id", "value", "ts")
    return quality.tail_screen(e.filter(~cut), e.filter(cut), "user_id", "value", 1.5).select("event_id", "value")


@query("SELECT event_id, value FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) WHERE s IS NULL OR s = 0 OR abs((value - m) / s) <= 3")
def zscore_cap(t: Tables):
    return quality.zscore_cap(t.events, "event_type", "value", 3.0).select("event_id", "value")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING stddev_samp(value) >= 45 AND avg(value) <= 50)")
def flat_and_broken_drop(t: Tables):
    return quality.drop_keys(t.events, "user_id", "value", 45.0, 50.0).select("event_id")


@query(f"""WITH {GRID}, ab AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS da, last_value(value IGNORE NULLS) OVER p AS va,
first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS db, first_value(value IGNORE NULLS) OVER f AS vb FROM grid
WINDOW p AS (PARTITION BY key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, date, round(CASE WHEN value IS NOT NULL THEN value WHEN date - da <= 2 AND db - date <= 2 THEN va + (vb - va) * (date - da) / (db - da) END, 6) AS filled FROM ab""")
def gap_interpolate(t: Tables):
    return segments.interpolate(resample.grid(events_daily(t)), 2).select("key", "date", F.round("filled", 6).alias("filled"))


@query(f"""WITH {GRID} SELECT key, date, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS filled FROM grid""")
def fill_forward(t: Tables):
    return windows.fill(resample.grid(events_daily(t))).select("key", "date", F.round("filled", 6).alias("filled"))


@query("""WITH r AS (SELECT user_id AS key, ts, floor(value / 40) AS value, event_id FROM events), n AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS s FROM r WINDOW w AS (PARTITION BY key ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts) AS run FROM n), p AS (SELECT key, run, min(ts) AS a, max(ts) AS b, any_value(value) AS v FROM g GROUP BY 1, 2)
SELECT key, CAST(v AS BIGINT) AS last_value, epoch_us(b) - epoch_us(a) > 24 * 3600000000 AS stuck FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS k FROM p) WHERE k = 1""")
def stuck_run_flag(t: Tables):
    r = t.events.select(F.col("user_id").alias("key"), "ts", F.floor(F.col("value") / 40).alias("value"))
    return segments.stuck(r).select("key", "last_value", "stuck")


NORMALS = f"""{MONTHLY}, cutoff AS (SELECT date_trunc('month', max(date) + 1) AS m FROM daily),
normals AS (SELECT key, month(month) AS month, quantile_cont(value, [0.1, 1.0/3, 0.5, 2.0/3, 0.9]) AS q, count(*) AS years FROM monthly, cutoff WHERE month < m GROUP BY 1, 2 HAVING count(*) >= 5)"""


def _before(t: Tables):
    """The first day that isn't known yet; one row of the raw table, so it is read before the plan is built."""
    return F.lit(t.lineitem.filter("l_extendedprice is not null").agg(F.date_add(F.to_date(F.max("l_shipdate")), 1)).head()[0])


@query(f"WITH {NORMALS} SELECT key, month, round(q[1], 7) AS p10, round(q[2], 7) AS t1, round(q[3], 7) AS median, round(q[4], 7) AS t2, round(q[5], 7) AS p90, years FROM normals")
def monthly_normals(t: Tables):
    s = supplier_daily(t)
    return normals.monthly_normals(s, _before(t)).select("key", "month", *[F.round(c, 7).alias(c) for c in normals.RUNGS], "years")


@query(f"""WITH {NORMALS}, last AS (SELECT key, max(date) AS date, max_by(value, date) AS level FROM daily GROUP BY key),
earlier AS (SELECT d.key, max_by(d.value, d.date) AS prev FROM daily d JOIN last USING (key) WHERE d.date <= last.date - 7 GROUP BY d.key)
SELECT last.key, last.date, round(level, 7) AS level,
 round(CASE WHEN level < q[1] THEN 2 WHEN level > q[5] THEN 98 WHEN level >= q[4] THEN 200.0/3 + (level - q[4]) / (q[5] - q[4]) * (90 - 200.0/3) WHEN level >= q[3] THEN 50 + (level - q[3]) / (q[4] - q[3]) * (200.0/3 - 50)
  WHEN level >= q[2] THEN 100.0/3 + (level - q[2]) / (q[3] - q[2]) * (50 - 100.0/3) WHEN level >= q[1] THEN 10 + (level - q[1]) / (q[2] - q[1]) * (100.0/3 - 10) END, 7) AS percentile,
 CASE WHEN level < q[2] THEN 'below' WHEN level > q[4] THEN 'above' WHEN q IS NOT NULL THEN 'near' END AS status, round(level - prev, 7) AS change,
 CASE WHEN level - prev > 0.02 THEN 'rising' WHEN level - prev < -0.02 THEN 'falling' WHEN prev IS NOT NULL THEN 'stable' END AS trend
FROM last LEFT JOIN earlier ON last.key = earlier.key LEFT JOIN normals n ON n.key = last.key AND n.month = month(last.date)""")
def current_status(t: Tables):
    s = supplier_daily(t)
    return normals.current_status(s, _before(t)).select("key", "date", *[F.round(c, 7).alias(c) for c in ("level", "percentile")], "status", F.round("change", 7).alias("change"), "trend")


@query("""WITH d AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
o AS (SELECT key, dayofyear(date) AS doy, avg(value) AS m FROM d GROUP BY 1, 2), a AS (SELECT key, avg(value) AS v FROM d GROUP BY 1)
SELECT a.key, CAST(r.doy AS INTEGER) AS doy, round(coalesce(o.m, a.v), 4) AS mean FROM a, range(1, 367) r(doy) LEFT JOIN o ON o.key = a.key AND o.doy = r.doy""")
def doy_climatology(t: Tables):
    d = resample.daily(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice", "sum")
    return normals.day_climatology(d).select("key", "doy", F.round("mean", 4).alias("mean"))


@query("""WITH d AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT *, dayofyear(date) - CASE WHEN (year(date) % 4 = 0 AND year(date) % 100 <> 0 OR year(date) % 400 = 0) AND dayofyear(date) >= 60 THEN 1 ELSE 0 END AS axis_day FROM d WHERE year(date) < 2000)
SELECT key, axis_day, round(quantile_cont(value, 0.1), 4) AS lo, round(median(value), 4) AS mid, round(quantile_cont(value, 0.9), 4) AS hi, count(DISTINCT year(date)) AS years FROM s GROUP BY 1, 2 HAVING count(DISTINCT year(date)) >= 3""")
def season_envelope(t: Tables):
    d = resample.daily(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice", "sum")
    return normals.envelope(d, season_day(F.col("date")), 2000).select("key", "axis_day", *[F.round(c, 4).alias(c) for c in ("lo", "mid", "hi")], "years")


X = "(month - min(month) OVER (PARTITION BY key)) / 365.25"
OLS = f"{MONTHLY}, x AS (SELECT *, {X} AS x FROM monthly), ols AS (SELECT key, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2, count(*) AS n FROM x GROUP BY key HAVING count(*) >= 3)"


@query(f"WITH {OLS} SELECT key, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(r2, 8) AS r2, n FROM ols")
def ols_trend(t: Tables):
    return trend.ols(supplier_monthly(t)).select("key", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


@query(f"WITH {MONTHLY} SELECT a.key, round(median((b.value - a.value) / ((b.month - a.month) / 365.25)), 4) AS slope FROM monthly a JOIN monthly b ON a.key = b.key AND a.month < b.month GROUP BY a.key")
def theil_sen(t: Tables):
    return trend.theil_sen(supplier_monthly(t)).withColumn("slope", F.round("slope", 4))


@query(f"""WITH {OLS}, e AS (SELECT key, year(month) + CASE WHEN month(month) >= 10 THEN 1 ELSE 0 END AS wy, value - slope * x - intercept AS e FROM x JOIN (SELECT * FROM ols WHERE n >= 12) USING (key)),
r AS (SELECT key, max(e) - min(e) AS r FROM e GROUP BY key, wy HAVING count(*) >= 6) SELECT key, round(median(r), 4) AS amplitude FROM r GROUP BY key""")
def seasonal_amplitude(t: Tables):
    return trend.seasonal_amplitude(supplier_monthly(t)).withColumn("amplitude", F.round("amplitude", 4))


@query(f"""WITH {EVENTS_DAILY}, d AS (SELECT a.key, abs(a.value - b.value) AS d FROM daily a JOIN daily b ON a.key = b.key AND b.date = a.date - 1), s AS (SELECT key, quantile_cont(d, 0.95) AS q FROM d GROUP BY key)
SELECT key, round(max(d), 6) AS max_step, count(*) FILTER (d > 50 AND d > 1.0 * q) AS n_steps FROM d JOIN s USING (key) GROUP BY key""")
def step_metrics(t: Tables):
    return windows.steps(events_daily(t), 50.0, 1.0).withColumn("max_step", F.round("max_step", 6))


@query(f"""WITH {MONTHLY}, r AS (SELECT l_suppkey AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
a AS (SELECT key, month, value - avg(value) OVER (PARTITION BY key, month(month)) AS x FROM monthly), b AS (SELECT key, month, value - avg(value) OVER (PARTITION BY key, month(month)) AS y FROM r),
c AS (SELECT key, month, sum(y) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) AS cum FROM b)
SELECT key, CASE WHEN count(*) >= 12 THEN round(corr(x, cum), 8) END AS corr, count(*) AS months FROM a JOIN c USING (key, month) GROUP BY key""")
def rain_coherence(t: Tables):
    rain = resample.monthly(resample.daily(t.lineitem, "l_suppkey", "l_shipdate", "l_quantity", "sum"), "sum")
    return trend.coherence(supplier_monthly(t), rain).withColumn("corr", F.round("corr", 8))


@query(f"""WITH {MONTHLY}, a AS (SELECT key, value, lag(value) OVER (PARTITION BY key ORDER BY month) AS b, avg(value) OVER (PARTITION BY key, month(month)) AS mm FROM monthly)
SELECT key, round(corr(value, b), 8) AS lag1, round(var_pop(mm) / var_pop(value), 8) AS seasonal_share FROM a GROUP BY key""")
def residual_checks(t: Tables):
    return trend.residual_checks(supplier_monthly(t)).select("key", F.round("lag1", 8).alias("lag1"), F.round("seasonal_share", 8).alias("seasonal_share"))


@query(f"""WITH {EVENTS_DAILY}, d AS (SELECT a.key, a.value - b.value AS d FROM daily a JOIN daily b ON a.key = b.key AND b.date = a.date - 1), m AS (SELECT key, median(d) AS m, count(*) AS n FROM d GROUP BY key)
SELECT key, CASE WHEN n >= 10 THEN round(1.4826 * median(abs(d - m)), 9) END AS sd FROM d JOIN m USING (key) GROUP BY key, n""")
def innovation_sd(t: Tables):
    return windows.noise(events_daily(t)).withColumn("sd", F.round("sd", 9))


@query(f"WITH {EVENTS_DAILY} SELECT a.key, round(median(b.value - a.value), 6) AS change FROM daily a JOIN daily b ON a.key = b.key AND b.date = a.date + 14 GROUP BY a.key")
def recession_baseline(t: Tables):
    return windows.recession(events_daily(t)).withColumn("change", F.round("change", 6))


@query(f"""WITH RECURSIVE {EVENTS_DAILY}, n AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY date) AS i FROM daily),
s AS (SELECT key, i, 0.3 * value AS state FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, 0.8 * s.state + 0.3 * n.value FROM s JOIN n ON n.key = s.key AND n.i = s.i + 1)
SELECT key, round(max_by(state, i), 6) AS state FROM s GROUP BY key""")
def linear_recurrence(t: Tables):
    return windows.recurrence(events_daily(t), 0.8, 0.3).withColumn("state", F.round("state", 6))


@query(f"WITH {EVENTS_DAILY} SELECT key, date, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY date) <= floor(count(*) OVER (PARTITION BY key) * 0.7) THEN 'train' ELSE 'test' END AS part FROM daily")
def train_test_split(t: Tables):
    return windows.split_by_time(events_daily(t), 0.7).select("key", "date", "part")


@query(f"""WITH {EVENTS_DAILY}, axis AS (SELECT DISTINCT user_id AS key, CAST(d AS DATE) AS date FROM events, generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 7 DAY) g(d))
SELECT axis.key, axis.date, CASE WHEN axis.date - o.date <= 3 THEN round(o.value, 6) END AS value, CASE WHEN axis.date - o.date <= 3 THEN o.date END AS seen FROM axis ASOF LEFT JOIN daily o ON axis.key = o.key AND axis.date >= o.date""")
def as_of_weekly(t: Tables):
    axis = t.events.select(F.col("user_id").alias("key")).distinct().select("key", F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-05', interval 7 day)")).alias("date"))
    return segments.as_of(axis, events_daily(t), 3).select("key", "date", F.round("value", 6).alias("value"), "seen")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT date, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS wy, round(sin(2 * pi() * dayofyear(date) / 365.25), 8) + 0.0 AS season_sin, round(cos(2 * pi() * dayofyear(date) / 365.25), 8) + 0.0 AS season_cos,
CAST(day(last_day(date)) AS INTEGER) AS days, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS next_month FROM d""")
def date_features(t: Tables):
    d = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    s = seasonality(F.col("date"))
    return d.select("date", water_year(F.col("date")).alias("wy"), *[F.round(c, 8).alias(n) for n, c in s.items()], F.day(F.last_day("date")).alias("days"), F.add_months(F.trunc("date", "MM"), 1).alias("next_month"))


@query(f"""WITH {EVENTS_DAILY}, f AS (SELECT key, date, value, {_lag(1)} AS lag_1, {_roll(3)} FROM daily a WINDOW {_win(3)})
SELECT key, date, round(value, 6) AS value, round(lag_1, 6) AS lag_1, sum_3, round(greatest(value - coalesce(lag_1, 0), 0), 6) AS effective FROM f WHERE lag_1 IS NOT NULL AND sum_3 IS NOT NULL""")
def feature_table(t: Tables):
    f = windows.rolling_full(windows.calendar_lags(events_daily(t), (1,)), (3,)).na.drop(subset=["lag_1", "sum_3"])
    return f.select("key", "date", F.round("value", 6).alias("value"), F.round("lag_1", 6).alias("lag_1"), F.round("sum_3", 6).alias("sum_3"), F.round(effective_rain(F.col("value"), F.col("lag_1")), 6).alias("effective"))
