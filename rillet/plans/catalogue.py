"""Catalogue, matching, sorting, set and document queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import half_up, normal_name, percent_text, pipe_parts, slug, uri_tail
from ..operators import matching, picks, windows
from .registry import Tables, query
from .spatial import KM, _places, places


@query("""SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS tail, regexp_extract(url, '/([a-z]{2})/', 1) AS part, CASE WHEN url LIKE '%utm_%' THEN 'tracked' WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'anchor' ELSE 'plain' END AS kind,
coalesce(TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INTEGER), 0) AS page FROM pages""")
def measure_parse(t: Tables):
    u = F.col("url")
    kind = F.when(u.contains("utm_"), "tracked").when(u.contains("?"), "query").when(u.contains("#"), "anchor").otherwise("plain")
    return t.pages.select("page_id", uri_tail(u).alias("tail"), F.regexp_extract(u, "/([a-z]{2})/", 1).alias("part"), kind.alias("kind"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') as int)"), F.lit(0)).alias("page"))


@query("""WITH p AS (SELECT p_partkey, ' ' || replace(p_name, ' ', ' | ') || ' || ' || p_type AS s FROM part) SELECT p_partkey, trim(x) AS piece FROM (SELECT p_partkey, unnest(string_split(s, '|')) AS x FROM p) WHERE trim(x) <> ''""")
def pipe_explode(t: Tables):
    s = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" || "), F.col("p_type"))
    return t.part.select("p_partkey", F.explode(pipe_parts(s)).alias("piece"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_members(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-') || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS slug
FROM part WINDOW w AS (PARTITION BY lower(p_name || ' ' || p_brand) ORDER BY p_partkey)""")
def collision_slugs(t: Tables):
    base = slug(F.concat_ws(" ", "p_name", "p_brand"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return t.part.select("p_partkey", base.alias("base")).select("p_partkey", F.concat(F.col("base"), F.when(n == 1, "").otherwise(F.concat(F.lit("-"), n.cast("string")))).alias("slug"))


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type <> 'ECONOMY' OR p_type IS NULL) AS other FROM part GROUP BY ROLLUP (p_brand)""")
def two_way_counts(t: Tables):
    e = F.coalesce(F.col("p_type") == "ECONOMY", F.lit(False))
    return t.part.rollup("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(e).alias("economy"), F.count_if(~e).alias("other"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, sum(o_totalprice) AS v, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1),
k AS (SELECT *, CASE WHEN v >= 4e6 THEN 0 WHEN v >= 2e6 THEN 1 ELSE 2 END AS tier, v / n * (1 - 0.5 * f / n) AS score FROM s)
SELECT o_custkey, tier, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY tier, last DESC, round(score, 4) DESC, o_custkey) AS INTEGER) AS place FROM k QUALIFY place <= 50""")
def triage_sort(t: Tables):
    """The first 50 of ``triage_order``."""
    k, order = _triage(t)
    # A top list: the limit is the feature, and it is taken before the rank, in one pass over each task's best.
    return k.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("o_custkey", "tier", "score", "place")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, sum(o_totalprice) AS v, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1),
k AS (SELECT *, CASE WHEN v >= 4e6 THEN 0 WHEN v >= 2e6 THEN 1 ELSE 2 END AS tier, v / n * (1 - 0.5 * f / n) AS score FROM s)
SELECT o_custkey, tier, round(score, 4) AS score, row_number() OVER (ORDER BY tier, last DESC, round(score, 4) DESC, o_custkey) AS place FROM k""")
def triage_order(t: Tables):
    """Every customer with its place."""
    k, order = _triage(t)
    return windows.places_in_order(k, order).select("o_custkey", "tier", "score", "place")


def _triage(t: Tables):
    s = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"), F.sum("o_totalprice").alias("v"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    k = s.select("o_custkey", "last", F.when(F.col("v") >= 4e6, 0).when(F.col("v") >= 2e6, 1).otherwise(2).alias("tier"), F.round(F.col("v") / F.col("n") * (1 - 0.5 * F.col("f") / F.col("n")), 4).alias("score"))
    order = [F.col("tier"), F.col("last").desc(), F.col("score").desc(), F.col("o_custkey")]
    return k, order


@query("""WITH a AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS lo, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS hi FROM customer)
SELECT c_mktsegment, c_custkey, c_acctbal, CASE WHEN lo <= 2 THEN 'lowest' ELSE 'highest' END AS kind FROM a WHERE lo <= 2 OR hi = 1""")
def notable_pick(t: Tables):
    return picks.notable(t.customer, "c_mktsegment", "c_acctbal", "c_custkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), x AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3)
SELECT 'both' AS scope, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'allowed', k FROM (SELECT k FROM b EXCEPT SELECT k FROM x)""")
def scope_algebra(t: Tables):
    a = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    b = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    x = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("k"))
    scope = lambda df, n: df.select(F.lit(n).alias("scope"), "k")
    return scope(a.intersect(b), "both").unionByName(scope(a.union(b).distinct(), "either")).unionByName(scope(b.exceptAll(x), "allowed"))


MATCH = f"""l AS (SELECT c_custkey AS id, c_name AS name, lat, lon, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS ref FROM customer JOIN ({_places('customer', 'c_custkey')}) ON id = c_custkey),
r AS (SELECT s_suppkey AS id, 'customer ' || s_suppkey * 7 AS name, lat, lon, s_suppkey * 3 AS ref FROM supplier JOIN ({_places('supplier', 's_suppkey')}) ON id = s_suppkey)"""


@query(f"""WITH {MATCH}, c AS (SELECT l.id AS a, r.id AS b, 1 AS tier, 0.0 AS d FROM l JOIN r ON l.ref = r.ref UNION ALL SELECT l.id, r.id, 2, {KM} FROM l, r WHERE {KM} <= 0.05)
SELECT a, b, tier FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY tier, round(d, 6), b) AS k FROM c) WHERE k = 1""")
def entity_match_cascade(t: Tables):
    """The exact tiers of the cascade: reference, then coordinates. ``entity_match_names`` adds the name tiers."""
    l, r = _entities(t)
    return matching.cascade(l, r, names=False).select("a", "b", "tier")


def _entities(t: Tables):
    l = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("ref")).join(places(t.customer, "c_custkey"), "id")
    r = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("customer "), (F.col("s_suppkey") * 7).cast("string")).alias("name"), (F.col("s_suppkey") * 3).alias("ref")).join(places(t.supplier, "s_suppkey"), "id")
    return l, r


@query()
def entity_match_names(t: Tables):
    return matching.cascade(*_entities(t), names=True)


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')), ' ') AS name FROM part")
def normalised_names(t: Tables):
    return t.part.select("p_partkey", normal_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))


@query("""WITH p AS (SELECT c_custkey, least(greatest(c_acctbal / 10000, 0), 1) AS p FROM customer) SELECT c_custkey, CASE WHEN p > 0 AND floor(p * 100 + 0.5) < 1 THEN '<1%' WHEN p < 1 AND floor(p * 100 + 0.5) > 99 THEN '>99%' ELSE CAST(CAST(floor(p * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS said,
CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS rounded FROM p JOIN customer USING (c_custkey)""")
def percent_labels(t: Tables):
    p = F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0))
    return t.customer.select("c_custkey", percent_text(p).alias("said"), half_up(F.col("c_acctbal") / 100).alias("rounded"))


@query("""WITH l AS (SELECT CAST(ts AS DATE) AS date, event_type, median(abs(value - 30)) AS e FROM events GROUP BY 1, 2), b AS (SELECT date, arg_min(event_type, e) AS source, min(e) AS e FROM l GROUP BY 1), k AS (SELECT * FROM b WHERE e <= 40),
n AS (SELECT *, CASE WHEN lag(date) OVER w = date - 1 THEN lag(source) OVER w ELSE source END AS p, CASE WHEN lead(date) OVER w = date + 1 THEN lead(source) OVER w ELSE source END AS q FROM k WINDOW w AS (ORDER BY date)) SELECT date, source, round(e, 6) AS e, p = source AND q = source AS interior FROM n""")
def attribution_and_interior(t: Tables):
    per = t.events.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("source")).agg(F.median(F.abs(F.col("value") - 30)).alias("e"))
    return picks.interior(picks.attributed(per, 40.0)).withColumn("e", F.round("e", 6))


@query("""SELECT s_nationkey, to_json({'nation': n_name, 'n': count(*), 'keys': list(s_suppkey ORDER BY s_suppkey)}) AS doc FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey, n_name""")
def json_documents(t: Tables):
    d = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("s_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    return d.select("s_nationkey", F.to_json(F.struct(F.col("n_name").alias("nation"), "n", "keys")).cast("string").alias("doc"))


@query("""WITH b AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS x, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS y, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN x > 0 AND y IS NOT NULL AND n >= 30 THEN least(greatest(y / x, 0.2), 5) ELSE 1 END, 6) AS factor FROM b""")
def bias_factor(t: Tables):
    pick = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    b = t.lineitem.groupBy("l_suppkey").agg(pick("A").alias("x"), pick("R").alias("y"), F.count(F.lit(1)).alias("n"))
    return b.select("l_suppkey", F.round(picks.bias(F.col("x"), F.col("y"), F.col("n")), 6).alias("factor"))


@query("""WITH d AS (SELECT l_suppkey AS key, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT week, round(avg(v), 6) AS mean, count(*) AS n FROM d WHERE days >= 2 GROUP BY week""")
def weekly_totals(t: Tables):
    r = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"))
    return picks.weekly(r, 2).withColumn("mean", F.round("mean", 6))


@query("""SELECT l_suppkey AS key, list_sort(list(l_extendedprice))[CAST(least(count(*), floor(0.2 * count(*)) + 1) AS BIGINT)] AS lo, list_sort(list(l_extendedprice))[CAST(least(count(*), floor(0.8 * count(*)) + 1) AS BIGINT)] AS hi FROM lineitem GROUP BY 1 HAVING count(*) >= 26""")
def nearest_rank_quantiles(t: Tables):
    return picks.nearest_rank(t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("value")), {"lo": 0.2, "hi": 0.8})


@query("""WITH m AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT o_custkey, arg_max(o_orderpriority, n * 10 - CAST(left(o_orderpriority, 1) AS INTEGER)) AS mode FROM m GROUP BY 1)
SELECT o_orderkey FROM orders JOIN k USING (o_custkey) WHERE o_orderpriority = mode""")
def modal_cohort(t: Tables):
    return picks.modal(t.orders, "o_custkey", "o_orderpriority").select("o_orderkey")


@query("""WITH p AS (SELECT p_partkey, p_size, p_retailprice, ntile(1) OVER () AS z FROM part) SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice > 1000 THEN 'severe' WHEN p_size > 40 THEN 'strong' WHEN p_size > 20 THEN 'moderate' ELSE 'none' END AS rung FROM p WHERE p_size > 20""")
def severity_floor(t: Tables):
    rung = picks.first_rule(((F.col("p_size") > 40) & (F.col("p_retailprice") > 1000), "severe"), (F.col("p_size") > 40, "strong"), (F.col("p_size") > 20, "moderate"), other="none")
    return t.part.select("p_partkey", rung.alias("rung")).filter(picks.at_least(F.col("rung"), ["none", "moderate", "strong", "severe"], "moderate"))
