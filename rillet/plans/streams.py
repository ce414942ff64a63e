"""Incremental queries, in batch form; ``rillet.streaming`` runs the same operators on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, resample
from .registry import Tables, query
from .series import EVENTS_DAILY, events_daily

RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END"


@query(f"SELECT user_id, date, event_id, event_type, value FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY {RANK}, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_precedence(t: Tables):
    e = t.events.withColumn("date", F.to_date("ts"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return incremental.precedence(e, ["user_id", "date"], rank, F.struct("ts", "event_id")).select("user_id", "date", "event_id", "event_type", "value")


@query("SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def archive_dedup(t: Tables):
    return incremental.precedence(t.events, ["event_type", "user_id"], F.lit(0), F.struct("ts", "event_id")).select("event_type", "user_id", "value")


@query(f"WITH {EVENTS_DAILY} SELECT key, date, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS k FROM daily) WHERE k <= 7")
def history_cap(t: Tables):
    return incremental.newest(events_daily(t), "key", "date", 7).withColumn("value", F.round("value", 6))


@query(f"""WITH {EVENTS_DAILY}, n AS (SELECT key, date, lead(date) OVER (PARTITION BY key ORDER BY date) AS n FROM daily) SELECT key, date + 1 AS "from", n - 1 AS "to", CAST(n - date - 1 AS INTEGER) AS days FROM n WHERE n - date > 1""")
def missing_ranges(t: Tables):
    return incremental.missing_ranges(events_daily(t))


@query("""WITH l AS (SELECT user_id AS key, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1) SELECT key, last, CAST(DATE '2024-02-10' - last AS INTEGER) AS age, CASE WHEN DATE '2024-02-10' - last <= 7 THEN 'current' WHEN DATE '2024-02-10' - last <= 30 THEN 'recent' WHEN DATE '2024-02-10' - last <= 90 THEN 'ageing' WHEN DATE '2024-02-10' - last <= 365 THEN 'old' ELSE 'stale' END AS label FROM l""")
def freshness_bands(t: Tables):
    return incremental.freshness(t.events, "user_id", "ts", F.lit("2024-02-10").cast("date"))


@query(f"""WITH {EVENTS_DAILY}, o AS (SELECT * FROM daily WHERE date <= DATE '2024-01-20'), f AS (SELECT key, date, value * 1.1 AS value FROM daily WHERE date >= DATE '2024-01-15')
SELECT key, date, round(value, 6) AS value FROM f UNION ALL SELECT key, date, round(value, 6) FROM o ANTI JOIN f USING (key, date)""")
def bridge_splice(t: Tables):
    d = events_daily(t)
    f = d.filter("date >= date'2024-01-15'").withColumn("value", F.col("value") * F.lit(1.1))
    return incremental.bridge(d.filter("date <= date'2024-01-20'"), f, ["key", "date"]).select("key", "date", F.round("value", 6).alias("value"))


_days = lambda what: f"SELECT DISTINCT CAST(ts AS DATE) + CAST(user_id * 100 AS INTEGER) AS key FROM events WHERE event_type = '{what}'"


@query(f"WITH a AS ({_days('view')}), b AS ({_days('error')}) SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)")
def coverage_difference(t: Tables):
    """Days (of users, told apart by a hundred days each) on which one kind of event alone was met."""
    days = lambda what: t.events.filter(F.col("event_type") == what).select(F.date_add(F.to_date("ts"), (F.col("user_id") * 100).cast("int")).alias("key"))
    return incremental.coverage_difference(days("view"), days("error"), "key")


@query("""SELECT s_suppkey, CAST(d AS DATE) AS "from", CAST(least(d + INTERVAL 1 YEAR, DATE '1998-06-15' + INTERVAL 0 DAY) AS DATE) AS "to" FROM supplier, generate_series(DATE '1995-01-01', DATE '1998-06-15', INTERVAL 1 YEAR) g(d)""")
def year_chunks(t: Tables):
    d = lambda s: F.lit(s).cast("date")
    return resample.year_chunks(t.supplier.select("s_suppkey", d("1995-01-01").alias("a"), d("1998-06-15").alias("b")), "a", "b").select("s_suppkey", "from", "to")
