"""Ensembles in long form: (key, member, date, value). No pivots: two levels of aggregation instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_up


def fan(members: DataFrame) -> DataFrame:
    """(key, date, lead, p10, p50, p90): quantiles over members of each day; a member's several values of a day are averaged first."""
    one = members.groupBy("key", "date", "member").agg(F.avg("value").alias("value"))
    q = one.groupBy("key", "date").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    lead = F.row_number().over(Window.partitionBy("key").orderBy("date"))
    return q.select("key", "date", lead.alias("lead"), *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def breach(members: DataFrame, threshold: str = "threshold", window: int = 14) -> DataFrame:
    """A key's chance that a member reaches its threshold, within the horizon and within ``window`` days; the share that never does; and the
    quantiles of first crossings, as leads and as the days at half-up leads. ``members`` carries the key's threshold."""
    one = members.groupBy("key", "date", "member", threshold).agg(F.avg("value").alias("value"))
    led = one.withColumn("lead", F.dense_rank().over(Window.partitionBy("key").orderBy("date")))
    hit = F.col("value") >= F.col(threshold)
    per = led.groupBy("key", "member").agg(F.min(F.when(hit, F.col("lead"))).alias("first"), F.max("lead").alias("last"))
    q = F.percentile("first", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = per.groupBy("key").agg(
        F.max("last").alias("horizon"), F.count(F.lit(1)).alias("members"), F.avg(F.col("first").isNotNull().cast("double")).alias("p_breach"),
        F.avg(F.coalesce(F.col("first") <= window, F.lit(False)).cast("double")).alias("p_breach_window"), q.alias("q"),
    )
    leads = led.select("key", "date", "lead").distinct()
    for i, name in enumerate(("p25", "median", "p75")):
        at = leads.select("key", F.col("lead").alias("_l"), F.col("date").alias(f"cross_{name}"))
        out = out.withColumn("_l", half_up(F.col("q")[i])).join(at, ["key", "_l"], "left").drop("_l")
    return out.select("key", "horizon", "members", "p_breach", "p_breach_window", (1 - F.col("p_breach")).alias("censored"), F.col("q")[1].alias("median_lead"), "cross_p25", "cross_median", "cross_p75")


def above_normal(members: DataFrame, normals: DataFrame, rung: str = "p90") -> DataFrame:
    """(key, p_above): share of members with a day over their month's rung; days of months without one don't count."""
    own = members.withColumn("month", F.month("date")).join(normals.select("key", "month", rung), ["key", "month"])
    return own.groupBy("key", "member").agg(F.bool_or(F.col("value") > F.col(rung)).alias("over")).groupBy("key").agg(F.avg(F.col("over").cast("double")).alias("p_above"))


def weighted_quantiles(df: DataFrame, quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """(key, q..) of (key, value, weight): linear between middles of cumulated weights, ends clamped."""
    w = Window.partitionBy("key").orderBy("value", "weight").rowsBetween(Window.unboundedPreceding, 0)
    mid = (F.sum("weight").over(w) - F.col("weight") / 2) / F.sum("weight").over(Window.partitionBy("key"))
    nxt = Window.partitionBy("key").orderBy("value", "weight")
    pts = df.filter("weight > 0").withColumn("c", mid)
    pts = pts.withColumns({"c2": F.lead("c").over(nxt), "v2": F.lead("value").over(nxt)})
    out = []
    for q in quantiles:
        line = F.when((F.col("c") <= q) & (F.col("c2") > q), F.col("value") + (F.col("v2") - F.col("value")) * (q - F.col("c")) / (F.col("c2") - F.col("c")))
        out.append(F.coalesce(F.max(line), F.when(F.min("c") > q, F.min_by("value", "c")).otherwise(F.max_by("value", "c"))).alias(f"q{round(q * 100)}"))
    return pts.groupBy("key").agg(*out)


def tercile_probabilities(totals: DataFrame, least: int = 10) -> DataFrame:
    """(key, below, near, above) of (key, member, value, t1, t2); a third each under ``least`` members."""
    enough = F.count("value") >= least
    share = lambda c: F.when(enough, F.avg(c.cast("double"))).otherwise(F.lit(1 / 3))
    v = F.col("value")
    return totals.groupBy("key").agg(share(v < F.col("t1")).alias("below"), share((v >= F.col("t1")) & (v <= F.col("t2"))).alias("near"), share(v > F.col("t2")).alias("above"))


def trace_weights(traces: DataFrame) -> DataFrame:
    """(key, trace, weight) of (key, trace, p): products of a trace's probabilities, made to sum to 1 over a key; equal ones if all are 0."""
    zero = F.max((F.col("p") <= 0).cast("int")) == 1
    raw = traces.groupBy("key", "trace").agg(F.when(zero, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(F.col("p") > 0, F.col("p")))))).alias("w"))
    all_ = Window.partitionBy("key")
    return raw.select("key", "trace", F.when(F.sum("w").over(all_) > 0, F.col("w") / F.sum("w").over(all_)).otherwise(1 / F.count(F.lit(1)).over(all_)).alias("weight"))


def covered_months(members: DataFrame) -> DataFrame:
    """(key, member, month, total): null unless all days of the month are there."""
    m = members.groupBy("key", "member", F.trunc("date", "MM").alias("month")).agg(F.sum("value").alias("t"), F.countDistinct("date").alias("d"))
    return m.select("key", "member", "month", F.when(F.col("d") == F.day(F.last_day("month")), F.col("t")).alias("total"))


def splice(head: DataFrame, tail: DataFrame) -> DataFrame:
    """The head, and after its last date the tail, of members that both have."""
    end = head.groupBy("key").agg(F.max("date").alias("_end"))
    both = head.select("key", "member").distinct()
    rest = tail.join(both, ["key", "member"], "left_semi").join(end, "key").filter("date > _end").drop("_end")
    return head.join(tail.select("key", "member").distinct(), ["key", "member"], "left_semi").unionByName(rest)
