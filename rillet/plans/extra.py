"""Queries of the further operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extra, quantiles, windows
from .registry import Tables, query
from .series import EVENTS_DAILY, events_daily
from .spatial import _places, places

DAILY_PRIORITY = "daily AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def priority_daily(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))


@query(f"""WITH {DAILY_PRIORITY}, y AS (SELECT key, unnest(generate_series(min(year(date)), max(year(date)))) AS year FROM daily GROUP BY key)
SELECT y.key, CAST(y.year AS INTEGER) AS year, CAST(l AS INTEGER) AS lead, round(value, 4) AS value FROM y, range(0, 45) r(l) JOIN daily d ON d.key = y.key AND d.date = make_date(y.year, 2, 28) + CAST(l AS INTEGER)""")
def trace_windows(t: Tables):
    return extra.trace_windows(priority_daily(t), 2, 29, 45).withColumn("value", F.round("value", 4))


@query(f"""WITH {EVENTS_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM daily)
SELECT DISTINCT n.key, n.date FROM n, range(0, 10) r(k) WHERE n <= 10 OR i = round_even(k * (n - 1) / 9.0, 0)""")
def even_downsample(t: Tables):
    return extra.downsample(events_daily(t), 10).select("key", "date")


@query("""WITH d AS (SELECT user_id, event_id, CAST(floor(value / 10) AS INTEGER) AS day, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT event_id, CAST(max(day - i) OVER (PARTITION BY user_id ORDER BY event_id) + i AS INTEGER) AS fixed FROM d""")
def monotone_days(t: Tables):
    d = t.events.select("user_id", "event_id", F.floor(F.col("value") / 10).cast("int").alias("day"))
    return extra.rising_days(d, "user_id", "event_id", "day").select("event_id", "fixed")


@query(f"""WITH {EVENTS_DAILY}, r AS (SELECT *, row_number() OVER w AS k, lead(date) OVER w AS d, lead(value) OVER w AS v FROM daily WINDOW w AS (PARTITION BY key ORDER BY date DESC))
SELECT key, round(value, 6) AS level, round(CASE WHEN date - d BETWEEN 1 AND 14 THEN (value - v) / (date - d) ELSE 0 END, 6) AS per_day FROM r WHERE k = 1""")
def seed_momentum(t: Tables):
    return extra.momentum(events_daily(t)).select("key", F.round("level", 6).alias("level"), F.round("per_day", 6).alias("per_day"))


@query(f"""WITH {EVENTS_DAILY}, c AS (SELECT a.key, a.value - b.value AS d FROM daily a JOIN daily b ON a.key = b.key AND b.date = a.date - 1), q AS (SELECT key, quantile_cont(d, 0.01) AS a, quantile_cont(d, 0.99) AS b FROM c GROUP BY key),
s AS (SELECT key, min(value) AS lo, max(value) AS hi FROM daily GROUP BY key) SELECT key, round(a, 8) AS lo_step, round(b, 8) AS hi_step, round(lo - 0.1 * (hi - lo), 8) AS lo, round(hi + 0.1 * (hi - lo), 8) AS hi FROM s LEFT JOIN q USING (key)""")
def guardrails(t: Tables):
    s = events_daily(t)
    return extra.guardrails(s, windows.differences(s)).select("key", *[F.round(c, 8).alias(c) for c in ("lo_step", "hi_step", "lo", "hi")])


@query("""WITH m AS (SELECT l_suppkey AS key, month(l_shipdate) AS m, avg(CASE WHEN l_discount <= 1e-4 THEN 1.0 ELSE 0 END) AS share FROM lineitem GROUP BY 1, 2)
SELECT key, coalesce(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FILTER (share >= 0.1), '') AS months FROM m GROUP BY key""")
def dry_months(t: Tables):
    s = t.lineitem.select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("value"))
    return extra.dry_months(s, 0.1).select("key", F.array_join("months", ",").alias("months"))


@query("""SELECT c_mktsegment, count(*) FILTER (p < 13) AS very_low, count(*) FILTER (p >= 13 AND p < 28) AS low, count(*) FILTER (p >= 28 AND p < 72) AS normal, count(*) FILTER (p >= 72 AND p < 87) AS high, count(*) FILTER (p >= 87) AS very_high
FROM (SELECT c_mktsegment, c_acctbal / 100 AS p FROM customer) GROUP BY 1""")
def percentile_bands(t: Tables):
    return extra.band_counts(t.customer.select("c_mktsegment", (F.col("c_acctbal") / 100).alias("p")), ["c_mktsegment"], "p")


@query(f"WITH {EVENTS_DAILY}, g AS (SELECT key, date - lag(date) OVER (PARTITION BY key ORDER BY date) AS g FROM daily) SELECT key, median(g) AS median_gap, CAST(max(g) AS INTEGER) AS max_gap, count(*) AS n FROM g GROUP BY key")
def gap_diagnostics(t: Tables):
    return extra.gap_diagnostics(events_daily(t))


@query("""WITH a AS (SELECT l_suppkey AS k, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_suppkey AS k, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem WHERE l_linenumber > 3 GROUP BY 1),
u AS (SELECT 'q' AS "column", abs(a.q - b.q) AS o FROM a JOIN b USING (k) UNION ALL SELECT 'x', abs(a.x - b.x) FROM a JOIN b USING (k)) SELECT "column", round(max(o), 8) AS max_off, round(avg(o), 8) AS mean_off, count(o) AS n FROM u GROUP BY 1""")
def frame_difference(t: Tables):
    g = lambda c: t.lineitem.filter(c).groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x"))
    return extra.frame_difference(g("l_linenumber <= 4"), g("l_linenumber > 3"), ["k"], ["q", "x"]).select("column", F.round("max_off", 8).alias("max_off"), F.round("mean_off", 8).alias("mean_off"), "n")


@query("SELECT l_orderkey, min(l_linenumber) FILTER (d = m) AS l_linenumber FROM (SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS d, min(abs(l_linenumber - 4)) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1")
def nearest_lead(t: Tables):
    return extra.nearest_lead(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", 4)


@query("SELECT date, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY 1, 2) GROUP BY date")
def multi_gauge_mean(t: Tables):
    d = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    return extra.mean_of_series(d).withColumn("value", F.round("value", 6))


_box = lambda table, key, w, form: f"SELECT id, lon AS x1, lat AS y1, lon + {w} AS x2, lat + {w} AS y2, {form} AS form FROM ({_places(table, key)})"


@query(f"""WITH a AS ({_box("supplier", "s_suppkey", 0.11, "NULL")}), b AS ({_box("customer", "c_custkey", 0.13, "CASE id % 3 WHEN 0 THEN 'canal' WHEN 1 THEN 'river' END")})
SELECT a.id AS a, b.id AS b FROM a, b WHERE a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 AND (b.form IS NULL OR b.form <> 'canal')""")
def box_overlaps(t: Tables):
    box = lambda df, key, w, form: places(df, key).select("id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + w).alias("x2"), (F.col("lat") + w).alias("y2"), form.alias("form"))
    form = F.when(F.col("id") % 3 == 0, "canal").when(F.col("id") % 3 == 1, "river")
    return extra.box_overlaps(t.spark, box(t.supplier, "s_suppkey", 0.11, F.lit(None).cast("string")), box(t.customer, "c_custkey", 0.13, form), "canal")


@query(f"""WITH RECURSIVE e AS (SELECT s_nationkey AS g, s_suppkey AS a, lead(s_suppkey, 1 + CAST(s_suppkey % 2 AS INTEGER)) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b, 1.0 + s_suppkey % 5 AS w FROM supplier),
p AS (SELECT g, b AS n, w AS l FROM e WHERE b IS NOT NULL UNION ALL SELECT p.g, e.b, p.l + e.w FROM p JOIN e ON e.g = p.g AND e.a = p.n WHERE e.b IS NOT NULL) SELECT g AS "group", max(l) AS length FROM p GROUP BY g""")
def longest_path(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    b = F.when(F.col("s_suppkey") % 2 == 0, F.lead("s_suppkey", 1).over(w)).otherwise(F.lead("s_suppkey", 2).over(w))
    e = t.supplier.select(F.col("s_nationkey").cast("long").alias("group"), F.col("s_suppkey").alias("a"), b.alias("b"), (1.0 + F.col("s_suppkey") % 5).alias("length")).filter("b is not null")
    return extra.longest_path(e).select("group", "length")


@query("""WITH s AS (SELECT c_custkey AS key, c_acctbal AS level, c_acctbal - 500 AS lo, c_acctbal + 500 AS hi FROM customer), r(rule, kind, bound) AS (VALUES ('a', 'above', 9000.0), ('b', 'below', 500.0), ('c', 'fan_above', 9200.0), ('d', 'fan_below', 100.0)),
w AS (SELECT key, CASE kind WHEN 'above' THEN level > bound WHEN 'below' THEN level < bound WHEN 'fan_above' THEN hi >= bound ELSE lo <= bound END AS v FROM s, r) SELECT key, CASE WHEN bool_or(v) THEN 'met' ELSE 'clear' END AS word FROM w GROUP BY key""")
def watch_rules(t: Tables):
    s = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("level"), (F.col("c_acctbal") - 500).alias("lo"), (F.col("c_acctbal") + 500).alias("hi"))
    rules = t.spark.createDataFrame([("a", "above", 9000.0), ("b", "below", 500.0), ("c", "fan_above", 9200.0), ("d", "fan_below", 100.0)], "rule string, kind string, bound double")
    return extra.worst(extra.watch(s, rules))


@query("SELECT event_type, round(greatest(1.0, quantile_cont(abs((value - 45) / 40), 0.8) / 1.2815515655446004), 8) AS k FROM events GROUP BY 1 HAVING count(*) >= 8")
def sigma_inflation(t: Tables):
    return extra.inflation(t.events.withColumn("z", (F.col("value") - 45) / 40), "event_type", "z").withColumn("k", F.round("k", 8))


@query("SELECT l_linenumber AS lead, round(sqrt(pow(2.0 * sqrt((1 - pow(0.9, 2 * l_linenumber)) / (1 - 0.81)), 2) + 0.25), 8) AS sigma FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def sigma_growth(t: Tables):
    d = t.lineitem.select("l_linenumber").distinct()
    return d.select(F.col("l_linenumber").alias("lead"), F.round(extra.sigma_growth(F.lit(0.9), F.lit(2.0), F.col("l_linenumber"), F.lit(0.5)), 8).alias("sigma"))


@query(f"""WITH {EVENTS_DAILY}, p AS (SELECT a.key, a.date, a.value, b.value AS y, c.value AS p3 FROM daily a LEFT JOIN daily b ON b.key = a.key AND b.date = a.date - 1 LEFT JOIN daily c ON c.key = a.key AND c.date = a.date - 3),
f AS (SELECT key, avg(value) AS m, greatest(coalesce(corr(value, y), 0), 0) AS phi FROM p GROUP BY key) SELECT key, date, round(p3, 6) AS persistence, round(m + pow(phi, 3) * (p3 - m), 6) AS damped FROM p JOIN f USING (key)""")
def baselines(t: Tables):
    return extra.baselines(events_daily(t), 3).select("key", "date", F.round("persistence", 6).alias("persistence"), F.round("damped", 6).alias("damped"))


@query()
def greedy_site_dedupe(t: Tables):
    p = places(t.customer, "c_custkey").withColumn("group", F.col("id") % 25)
    return extra.greedy_sites(p.select("group", "id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("id").alias("rank")), 0.8)


@query()
def simplified_lines(t: Tables):
    p = places(t.customer, "c_custkey").groupBy((F.col("id") % 20).alias("id_")).agg(F.array_sort(F.collect_list(F.struct("id", "lon", "lat"))).alias("a"))
    lines = p.select(F.col("id_").alias("id"), F.transform("a", lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y"))).alias("points"))
    return extra.simplify(lines, 0.5)


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, [round(q, 6) for q in quantile_cont(l_extendedprice, [0.1, 1.0/3, 0.5, 0.9, 0.999])] AS quantiles FROM lineitem GROUP BY 1, 2""")
def big_group_quantiles(t: Tables):
    """Exact quantiles of groups of which each has a good part of all rows, by rounds of counting instead of one task a group."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    found = quantiles.quantiles(rows, ["flag", "status"], "l_extendedprice", [0.1, 1 / 3, 0.5, 0.9, 0.999], bound=1000)
    return found.withColumn("quantiles", F.transform("quantiles", lambda q: F.round(q, 6)))
