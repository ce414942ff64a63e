"""Ensemble queries; members are users by remainder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, normals, resample
from .registry import Tables, query
from .series import NORMALS

MEMBERS = "members AS (SELECT event_type AS key, user_id % 51 AS member, CAST(ts AS DATE) AS date, value FROM events)"
ONE = f"{MEMBERS}, one AS (SELECT key, member, date, avg(value) AS value FROM members GROUP BY 1, 2, 3)"


def members(t: Tables):
    return t.events.select(F.col("event_type").alias("key"), (F.col("user_id") % 51).alias("member"), F.to_date("ts").alias("date"), "value")


@query(f"WITH {ONE} SELECT key, date, CAST(row_number() OVER (PARTITION BY key ORDER BY date) AS INTEGER) AS lead, round(quantile_cont(value, 0.1), 6) AS p10, round(median(value), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM one GROUP BY key, date")
def ensemble_fan(t: Tables):
    return ensemble.fan(members(t)).select("key", "date", "lead", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""WITH {ONE}, led AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY date) AS lead FROM one), per AS (SELECT key, member, min(CASE WHEN value >= 150 THEN lead END) AS f, max(lead) AS h FROM led GROUP BY 1, 2),
q AS (SELECT key, max(h) AS horizon, count(*) AS members, avg(CASE WHEN f IS NOT NULL THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN f <= 14 THEN 1.0 ELSE 0 END) AS p14, quantile_cont(f, 0.25) AS a, median(f) AS b, quantile_cont(f, 0.75) AS c FROM per GROUP BY key),
d AS (SELECT DISTINCT key, lead, date FROM led)
SELECT q.key, CAST(horizon AS INTEGER) AS horizon, members, round(p, 6) AS p_breach, round(p14, 6) AS p_breach_window, round(1 - p, 6) AS censored, b AS median_lead, da.date AS cross_p25, db.date AS cross_median, dc.date AS cross_p75
FROM q LEFT JOIN d da ON da.key = q.key AND da.lead = floor(a + 0.5) LEFT JOIN d db ON db.key = q.key AND db.lead = floor(b + 0.5) LEFT JOIN d dc ON dc.key = q.key AND dc.lead = floor(c + 0.5)""")
def breach_stats(t: Tables):
    out = ensemble.breach(members(t).withColumn("threshold", F.lit(150.0)))
    return out.select("key", "horizon", "members", *[F.round(c, 6).alias(c) for c in ("p_breach", "p_breach_window", "censored")], "median_lead", "cross_p25", "cross_median", "cross_p75")


LINES = "SELECT l_suppkey AS key, l_linenumber AS member, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS value FROM lineitem"


@query(f"""WITH {NORMALS}, m AS ({LINES}), o AS (SELECT m.key, member, bool_or(value > q[5]) AS over FROM m JOIN normals n ON n.key = m.key AND n.month = month(m.date) GROUP BY 1, 2)
SELECT key, round(avg(CASE WHEN over THEN 1.0 ELSE 0 END), 6) AS p_above FROM o GROUP BY key""")
def above_p90(t: Tables):
    m = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("member"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"))
    s = resample.daily(t.lineitem, "l_suppkey", "l_shipdate", "l_extendedprice")
    before = F.lit(s.agg(F.date_add(F.max("date"), 1)).head()[0])
    return ensemble.above_normal(m, normals.monthly_normals(s, before)).withColumn("p_above", F.round("p_above", 6))


_wq = lambda q, n: f"round(coalesce(max(CASE WHEN c <= {q} AND c2 > {q} THEN value + (v2 - value) * ({q} - c) / (c2 - c) END), CASE WHEN min(c) > {q} THEN min_by(value, c) ELSE max_by(value, c) END), 5) AS {n}"


@query(f"""WITH w AS (SELECT l_suppkey AS key, l_extendedprice + l_linenumber * 1e-3 AS value, l_quantity AS weight FROM lineitem WHERE l_quantity > 0),
c AS (SELECT *, (sum(weight) OVER (PARTITION BY key ORDER BY value, weight ROWS UNBOUNDED PRECEDING) - weight / 2) / sum(weight) OVER (PARTITION BY key) AS c FROM w),
l AS (SELECT *, lead(c) OVER o AS c2, lead(value) OVER o AS v2 FROM c WINDOW o AS (PARTITION BY key ORDER BY value, weight)) SELECT key, {_wq(0.1, "q10")}, {_wq(0.5, "q50")}, {_wq(0.9, "q90")} FROM l GROUP BY key""")
def weighted_quantile(t: Tables):
    w = t.lineitem.select(F.col("l_suppkey").alias("key"), (F.col("l_extendedprice") + F.col("l_linenumber") * 1e-3).alias("value"), F.col("l_quantity").alias("weight"))
    return ensemble.weighted_quantiles(w).select("key", *[F.round(c, 5).alias(c) for c in ("q10", "q50", "q90")])


_third = lambda e, n: f"round(CASE WHEN count(*) >= 10 THEN avg(CASE WHEN {e} THEN 1.0 ELSE 0 END) ELSE 1.0 / 3 END, 6) AS {n}"


@query(f"""WITH b AS (SELECT quantile_cont(l_quantity, 1.0 / 3) AS t1, quantile_cont(l_quantity, 2.0 / 3) AS t2 FROM lineitem)
SELECT l_suppkey AS key, {_third("l_quantity < t1", "below")}, {_third("l_quantity BETWEEN t1 AND t2", "near")}, {_third("l_quantity > t2", "above")} FROM lineitem, b GROUP BY 1""")
def tercile_probs(t: Tables):
    b = t.lineitem.agg(F.percentile("l_quantity", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("b")).head()[0]
    m = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("value"), F.lit(b[0]).alias("t1"), F.lit(b[1]).alias("t2"))
    return ensemble.tercile_probabilities(m).select("key", *[F.round(c, 6).alias(c) for c in ("below", "near", "above")])


@query("""WITH m AS (SELECT l_suppkey AS key, year(l_shipdate) AS trace, month(l_shipdate) AS month, round(avg(l_discount), 9) AS d FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT key, trace, CASE WHEN min(d) FILTER (month <= 3) <= 0 THEN 0 ELSE coalesce(exp(sum(ln(d + 0.5)) FILTER (month <= 3)), 1) END AS w FROM m GROUP BY 1, 2)
SELECT key, trace, round(CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END, 8) AS weight FROM r WINDOW p AS (PARTITION BY key)""")
def trace_weights_months(t: Tables):
    """Every (supplier, year) is a trace, weighed by the product over its first three months; a month without lines counts as 1."""
    d = F.round(F.avg("l_discount"), 9)
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("trace"), F.month("l_shipdate").alias("month")).agg(d.alias("d"))
    p = F.when(F.col("month") > 3, 1.0).when(F.col("d") <= 0, 0.0).otherwise(F.col("d") + 0.5)
    return ensemble.trace_weights(m.select("key", "trace", p.alias("p"))).withColumn("weight", F.round("weight", 8))


@query(f"""WITH {MEMBERS} SELECT key, member, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(DISTINCT date) = day(last_day(any_value(date))) THEN round(sum(value), 4) END AS total FROM members GROUP BY 1, 2, 3""")
def covered_month_totals(t: Tables):
    return ensemble.covered_months(members(t)).withColumn("total", F.round("total", 4))


@query(f"""WITH {MEMBERS}, h AS (SELECT * FROM members WHERE date <= DATE '2024-01-15' AND member < 40), l AS (SELECT * FROM members WHERE date > DATE '2024-01-10' AND member > 5), e AS (SELECT key, max(date) AS e FROM h GROUP BY key)
SELECT key, member, date, value FROM h WHERE (key, member) IN (SELECT key, member FROM l) UNION ALL SELECT l.key, member, date, value FROM l JOIN e ON e.key = l.key WHERE date > e AND (l.key, member) IN (SELECT key, member FROM h)""")
def spliced_members(t: Tables):
    m = members(t)
    return ensemble.splice(m.filter("date <= date'2024-01-15' and member < 40"), m.filter("date > date'2024-01-10' and member > 5"))
