"""Small compositions: each query is one operator of the inventory over plain DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normal_cdf
from ..operators import picks, resample, spatial, windows
from .registry import Tables, query
from .series import EVENTS_DAILY, GRID, events_daily
from .spatial import KM, _places, places


@query("""SELECT user_id AS key, CAST(ts AS DATE) AS date, round(avg(value), 6) AS mean, round(median(value), 6) AS mid, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS flagged, arg_min(event_type, event_id) AS label FROM events GROUP BY 1, 2""")
def daily_mean_median_flag_label(t: Tables):
    e = t.events.select(F.col("user_id").alias("key"), "ts", "value", F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    return picks.day_summary(e, F.col("label") == "error").withColumns({"mean": F.round("mean", 6), "mid": F.round("mid", 6)})


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, value FROM events WHERE event_type = 'view'), b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, value FROM events WHERE event_type = 'click')
SELECT user_id, round(corr(a.value, b.value), 8) AS r, round(avg(abs(a.value - b.value)), 6) AS mae, round(median(abs(a.value - b.value)), 6) AS mid, count(*) AS n FROM a JOIN b USING (user_id, r) GROUP BY 1 HAVING count(*) >= 5""")
def provider_parity(t: Tables):
    """Two providers' values matched by rank within a key."""
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    side = lambda kind, name: t.events.filter(F.col("event_type") == kind).select("user_id", F.row_number().over(w).alias("rank"), F.col("value").alias(name))
    out = picks.parity(side("view", "a").join(side("click", "b"), ["user_id", "rank"]).withColumnRenamed("user_id", "key"))
    return out.select(F.col("key").alias("user_id"), F.round("r", 8).alias("r"), F.round("mae", 6).alias("mae"), F.round("mid", 6).alias("mid"), "n")


@query(f"""WITH {GRID}, k(g, i, w) AS (VALUES (0, 1, 0.5), (0, 2, 0.3), (0, 3, 0.2), (1, 1, 0.2), (1, 2, 0.3), (1, 3, 0.5)), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS n FROM grid)
SELECT a.key, a.date, CASE WHEN max(a.n) > 3 THEN round(sum(coalesce(b.value, 0) * w), 6) END AS recharge FROM n a JOIN k ON k.g = a.key % 2 LEFT JOIN n b ON b.key = a.key AND b.date = a.date - CAST(k.i AS INTEGER) GROUP BY a.key, a.date""")
def kernel_by_group(t: Tables):
    """A kernel chosen by the key's group."""
    kernel = F.when(F.col("key") % 2 == 0, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    return picks.kernel_recharge(resample.grid(events_daily(t)), kernel, 3).select("key", "date", F.round("recharge", 6).alias("recharge"))


@query(f"WITH {EVENTS_DAILY} SELECT key, date, round(value, 6) AS value FROM (SELECT *, max(date) OVER (PARTITION BY key) AS m FROM daily) WHERE date >= m - 10")
def trailing_history(t: Tables):
    return picks.trailing(events_daily(t), 10).select("key", "date", F.round("value", 6).alias("value"))


@query(f"""WITH s AS (SELECT l_suppkey AS k, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1), l AS ({_places("supplier", "s_suppkey")}), r AS (SELECT * FROM l),
n AS (SELECT l.id AS a, r.id AS b FROM l, r WHERE l.id < r.id AND {KM} <= 60) SELECT n.a, n.b, least(x.b, y.b) - greatest(x.a, y.a) AS days FROM n JOIN s x ON x.k = n.a JOIN s y ON y.k = n.b WHERE least(x.b, y.b) - greatest(x.a, y.a) >= 2 * 365""")
def neighbour_overlap(t: Tables):
    """All pairs within 60 km whose records share two years."""
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last"))
    # The spans ride along with the places, so pairs meet them without a shuffle of their own.
    p = places(t.supplier, "s_suppkey").join(s, F.col("id") == F.col("key")).select(F.struct("id", "first", "last").alias("id"), "lat", "lon")
    return picks.spans_shared(spatial.within(p, p, 60.0).filter("a.id < b.id"), 730)


@query("""SELECT a.user_id, a.event_id, b.event_id AS event_id_b, round(a.value - b.value, 6) AS off FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def paired_difference(t: Tables):
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("date"), "event_id", "value")
    return picks.paired(side("view"), side("click"), ["user_id", "date"]).select("user_id", "event_id", "event_id_b", F.round("off", 6).alias("off"))


@query("""WITH l AS (SELECT p_type AS g, p_partkey FROM part) SELECT g, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM l GROUP BY g""")
def inverted_links(t: Tables):
    own = picks.inverted(t.part.select(F.col("p_type").alias("g"), "p_partkey"), "g", "p_partkey")
    return own.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query(f"""WITH {EVENTS_DAILY}, f AS (SELECT key, date + 3 AS date, value * 0.9 AS p10, value AS p50, value * 1.4 AS p90, date AS run FROM daily), j AS (SELECT f.*, d.value AS obs, row_number() OVER (PARTITION BY f.key, f.date ORDER BY run DESC) AS k FROM f JOIN daily d USING (key, date))
SELECT key, count(*) AS n, round(avg(CASE WHEN obs BETWEEN p10 AND p90 THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(abs(obs - p50)), 6) AS mae FROM j WHERE k = 1 GROUP BY key HAVING count(*) >= 8""")
def forecast_verification(t: Tables):
    d = events_daily(t)
    f = d.select("key", F.date_add("date", 3).alias("date"), (F.col("value") * 0.9).alias("p10"), F.col("value").alias("p50"), (F.col("value") * 1.4).alias("p90"), F.col("date").alias("run"))
    return picks.verified(f, d).withColumns({"coverage": F.round("coverage", 6), "mae": F.round("mae", 6)})


@query("""WITH u AS (SELECT l_partkey AS id, 'rain' AS kind, 0 AS p FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, 'flow', 1 FROM lineitem WHERE l_linenumber = 2) SELECT id, arg_min(kind, p) AS kind FROM u GROUP BY id""")
def unique_ids_first_type(t: Tables):
    one = lambda n, c: t.lineitem.filter(F.col("l_linenumber") == n).select(F.col(c).alias("id"))
    return picks.first_kind((one(1, "l_partkey"), "rain"), (one(2, "l_suppkey"), "flow"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 2 = 0 THEN 9000.0 END) AS threshold, CASE WHEN c_custkey % 5 = 0 THEN 'user' WHEN c_custkey % 2 = 0 THEN 'p90_proxy' ELSE 'none' END AS source FROM customer""")
def threshold_resolution(t: Tables):
    value, source = picks.resolved(("user", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal"))), ("p90_proxy", F.when(F.col("c_custkey") % 2 == 0, F.lit(9000.0))))
    return t.customer.select("c_custkey", value.alias("threshold"), source.alias("source"))


@query("""WITH l AS (SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN count(*) = count(d) THEN min(d) - 7 END AS start, count(*) - count(d) AS missing FROM l""")
def incremental_start(t: Tables):
    """Where a refresh starts: a week before the earliest tail, and from the beginning (null) if any key has none."""
    return picks.refresh_start(t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date")))


@query("""WITH r AS (SELECT l_suppkey AS k, year(l_shipdate) AS run, l_linenumber AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY run DESC) AS d FROM r)
SELECT k, max(v) FILTER (m = 1) AS m1, max(v) FILTER (m = 2) AS m2, max(v) FILTER (m = 3) AS m3 FROM n WHERE d = 1 GROUP BY k""")
def newest_run_pivot(t: Tables):
    r = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("run"), F.col("l_linenumber").alias("month")).agg(F.sum("l_quantity").alias("value"))
    return picks.newest_run(r, [1, 2, 3]).withColumnRenamed("key", "k")


@query("SELECT user_id % 14 AS lead, CASE WHEN count(*) >= 2 THEN round(greatest(stddev_samp(value - 45), 1e-3), 8) END AS sd FROM events GROUP BY 1")
def error_sd_by_lead(t: Tables):
    return picks.error_sd(t.events.select((F.col("user_id") % 14).alias("lead"), (F.col("value") - 45).alias("error"))).withColumn("sd", F.round("sd", 8))


@query(f"""WITH g AS (SELECT floor((lon + 5) / 0.5) AS i, floor((lat - 50) / 0.5) AS j, avg(id) AS v FROM ({_places("customer", "c_custkey")}) GROUP BY 1, 2)
SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, min(b.v) AS lo, max(b.v) AS hi FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2""")
def neighbourhood_envelope(t: Tables):
    """Extremes over a cell and the eight around it."""
    return picks.neighbourhood(places(t.customer, "c_custkey").groupBy(F.floor((F.col("lon") + 5) / 0.5).alias("i"), F.floor((F.col("lat") - 50) / 0.5).alias("j")).agg(F.avg("id").alias("v")))


@query(f"""WITH p AS ({_places("supplier", "s_suppkey")}), e AS (SELECT arg_max(id, lat * 1e4 - id * 1e-3) AS id FROM p UNION SELECT arg_min(id, lat * 1e4 + id * 1e-3) FROM p UNION SELECT arg_max(id, lon * 1e4 - id * 1e-3) FROM p UNION SELECT arg_min(id, lon * 1e4 + id * 1e-3) FROM p),
c AS (SELECT avg(lat) AS lat, avg(lon) AS lon FROM p), r AS (SELECT l.id, row_number() OVER (ORDER BY round({KM}, 6), l.id) AS k FROM p l, c r WHERE l.id NOT IN (SELECT id FROM e)) SELECT id FROM e UNION ALL SELECT id FROM r WHERE k <= 8 - (SELECT count(*) FROM e)""")
def spread_panel(t: Tables):
    """Eight places: the four extremes, then those nearest the centre."""
    return picks.spread_panel(places(t.supplier, "s_suppkey"), 8)


@query("""SELECT p_partkey, CASE WHEN upper(p_name) LIKE '%RING%' THEN 'ring' WHEN string_split(upper(p_name), ' ')[1] = 'RED' THEN 'red' WHEN string_split(upper(p_name), ' ')[1] IN ('SMALL', 'LARGE') THEN 'sized' ELSE 'other' END AS class FROM part""")
def keyword_classifier(t: Tables):
    u, first = F.upper("p_name"), F.element_at(F.split(F.upper("p_name"), " "), 1)
    return t.part.select("p_partkey", picks.first_rule((u.contains("RING"), "ring"), (first == "RED", "red"), (first.isin("SMALL", "LARGE"), "sized"), other="other").alias("class"))


@query("""WITH u AS (SELECT s_suppkey AS k, 'a' AS c, (s_suppkey * 37 % 100) / 100.0 AS v, 0 AS o FROM supplier UNION ALL SELECT s_suppkey, 'b', (s_suppkey * 53 % 100) / 100.0, 1 FROM supplier UNION ALL SELECT s_suppkey, 'c', (s_suppkey * 71 % 100) / 100.0, 2 FROM supplier)
SELECT k, arg_max(c, v * 1000 - o * 0.001) AS strongest FROM u WHERE v >= 0.5 GROUP BY k""")
def strongest_signal(t: Tables):
    s = {n: (F.col("s_suppkey") * m % 100) / 100.0 for n, m in (("a", 37), ("b", 53), ("c", 71))}
    return t.supplier.select(F.col("s_suppkey").alias("k"), picks.strongest(s).alias("strongest")).filter("strongest is not null")


@query("SELECT s_suppkey, round(4 + 10 * sqrt(least(greatest(s_acctbal, 0), 8000) / 8000), 8) AS radius FROM supplier")
def marker_radius(t: Tables):
    return t.supplier.select("s_suppkey", F.round(picks.marker_radius(F.col("s_acctbal"), 8000.0), 8).alias("radius"))


@query("""WITH e AS (SELECT s_nationkey AS g, s_suppkey AS a, (s_suppkey * 7) % 100 AS b FROM supplier) SELECT g, CASE WHEN a > b THEN b ELSE a END AS a, CASE WHEN a > b THEN a ELSE b END AS b, a > b AS turned FROM e""")
def oriented_edges(t: Tables):
    return picks.oriented(t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 100).alias("b")))


@query("""WITH s AS (SELECT l_suppkey AS k, abs(avg(l_extendedprice) - 50000) AS e1, abs(median(l_extendedprice) - 50000) AS e2, abs(min(l_extendedprice) - 50000) AS e3 FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN e1 * 1.1 <= e2 AND e1 * 1.1 <= 0.5 * e3 THEN 'mean' WHEN e2 <= 0.5 * e3 THEN 'median' ELSE 'least' END AS winner FROM s""")
def weighted_winner(t: Tables):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(*[F.abs(f("l_extendedprice") - 50000).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("least", F.min))])
    return s.select("k", picks.winner({n: F.col(n) for n in ("mean", "median", "least")}, {"mean": 1.1, "least": 0.5}).alias("winner"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def capped_selection(t: Tables):
    gone = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return picks.selection(t.customer.filter("c_acctbal > 0"), gone, "c_custkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 40).select("c_custkey")


@query("""WITH v AS (SELECT p_partkey, nullif(p_size % 7, 0) AS x FROM part) SELECT p_partkey, row_number() OVER (ORDER BY x DESC NULLS LAST, p_partkey) AS place FROM v QUALIFY place <= 100""")
def nulls_last_sort(t: Tables):
    x = F.nullif(F.col("p_size") % 7, F.lit(0))
    order = [F.col("x").desc_nulls_last(), F.col("p_partkey")]
    top = t.part.select("p_partkey", x.alias("x")).orderBy(*order).limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""WITH v AS (SELECT p_partkey, nullif(p_size % 7, 0) AS x FROM part) SELECT p_partkey, row_number() OVER (ORDER BY x NULLS LAST, p_partkey) AS up, row_number() OVER (ORDER BY x DESC NULLS LAST, p_partkey) AS down FROM v""")
def nulls_last_order(t: Tables):
    """Every part with its place in both directions."""
    v = t.part.select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("x"))
    up = windows.places_in_order(v, [F.col("x").asc_nulls_last(), F.col("p_partkey")], "up")
    return windows.places_in_order(up, [F.col("x").desc_nulls_last(), F.col("p_partkey")], "down").select("p_partkey", "up", "down")


@query("SELECT p_brand, p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def station_codes(t: Tables):
    return picks.codes(t.part, "p_brand").select("p_brand", "p_partkey", "code")


@query()
def mixture_terciles(t: Tables):
    """Tercile probabilities of a weighted normal mixture; Phi is approximated, so tests hold it against the library's."""
    m = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("mu"), (F.col("l_tax") + 0.5).alias("w"))
    z = lambda b: normal_cdf((F.lit(float(b)) - F.col("mu")) / 5.0)
    return m.groupBy("key").agg((F.sum(F.col("w") * z(17)) / F.sum("w")).alias("below"), (F.sum(F.col("w") * (1 - z(34))) / F.sum("w")).alias("above"))
