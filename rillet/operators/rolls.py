"""Forward rolls of a level: linear models of its next change, fitted a key and stepped day by day for every member of an ensemble.

A model's parameters are a row a key: coefficients (array), center, lo and hi of the level, lo_change and hi_change of a day. Drivers are rows of
(key, member, date, recharge, season_sin, season_cos). Steps of a member are one ordered array of a forecast's horizon, rolled natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fit import ols_multi

#: Rows that a fit needs by method; a key with fewer stays where it is.
LEAST = {"reduced": 30, "momentum": 40, "gated": 50}


def terms(method: str, level: Column, change: Column, rain: Column, sin: Column, cos: Column, center: Column) -> list[Column]:
    """What a method's change is linear in, beside the constant: recession to a rest level and recharge; with momentum and convex recharge; with a
    recession that recharge gates."""
    u = level - center
    return {"reduced": [level, rain, sin, cos], "momentum": [level, rain, change, rain * rain, sin, cos], "gated": [u, u * rain, rain, change, rain * rain, sin, cos]}[method]


def fit(history: DataFrame, method: str, margin: float = 0.1) -> DataFrame:
    """Parameters of each key of (key, date, value, recharge, season_sin, season_cos), by least squares over days that follow each other. Bounds: the
    1st and 99th percentile of a day's change, and the record's range widened by ``margin`` on both sides."""
    w = Window.partitionBy("key").orderBy("date")
    before = F.when(F.datediff("date", F.lag("date").over(w)) == 1, F.lag("value").over(w))
    d = history.withColumn("_level", before).withColumn("_change", F.col("value") - F.col("_level"))
    d = d.withColumn("_last", F.lag("_change").over(w))
    sound = d.na.drop(subset=["_change", "recharge", "season_sin", "season_cos", *(["_last"] if method != "reduced" else [])])
    center = sound.groupBy("key").agg(F.avg("_level").alias("center"))
    xs = terms(method, F.col("_level"), F.col("_last"), F.col("recharge"), F.col("season_sin"), F.col("season_cos"), F.col("center"))
    names = [f"_x{i}" for i in range(len(xs))]
    fitted = ols_multi(sound.join(center, "key").select("key", F.col("_change").alias("_y"), *[x.alias(n) for x, n in zip(xs, names)]), names, "_y", LEAST[method])
    span = d.groupBy("key").agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.percentile("_change", F.array(F.lit(0.01), F.lit(0.99))).alias("_q"))
    wide = (F.col("_b") - F.col("_a")) * margin
    out = span.join(fitted.select("key", "coefficients"), "key", "left").join(center, "key", "left")
    still = F.array_repeat(F.lit(0.0), len(xs) + 1)
    return out.select("key", F.coalesce("coefficients", still).alias("coefficients"), F.coalesce("center", F.lit(0.0)).alias("center"), F.col("_q")[0].alias("lo_change"), F.col("_q")[1].alias("hi_change"), (F.col("_a") - wide).alias("lo"), (F.col("_b") + wide).alias("hi"))


def _within(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def roll(drivers: DataFrame, params: DataFrame, seeds: DataFrame, method: str) -> DataFrame:
    """(key, member, date, value) of every day of ``drivers``, from ``seeds`` (key, level, change). Levels stay in their bounds, and but for the plain method
    changes too; null bounds don't bind. Keys without parameters or seeds have no roll."""
    days = F.array_sort(F.collect_list(F.struct("date", "recharge", "season_sin", "season_cos"))).alias("days")
    a = drivers.groupBy("key", "member").agg(days).join(params, "key").join(seeds.select("key", "level", "change"), "key")

    def step(state: Column, x: Column) -> Column:
        level, change = state["level"], state["change"]
        xs = [F.lit(1.0), *terms(method, level, change, x["recharge"], x["season_sin"], x["season_cos"], F.col("center"))]
        move = xs[0] * F.col("coefficients")[0]
        for i, v in enumerate(xs[1:], 1):
            move = move + v * F.col("coefficients")[i]
        if method != "reduced":
            move = _within(move, F.col("lo_change"), F.col("hi_change"))
        # A struct first, so that the move is worked out once.
        return F.struct(_within(level + move, F.col("lo"), F.col("hi")).alias("level"), move.alias("change"))

    start = F.struct(F.col("level").cast("double").alias("level"), F.col("change").cast("double").alias("change"))
    both = F.aggregate(
        "days", F.struct(start.alias("now"), F.array().cast("array<double>").alias("levels")),
        lambda s, x: F.transform(F.array(step(s["now"], x)), lambda n: F.struct(n.alias("now"), F.concat(s["levels"], F.array(n["level"])).alias("levels")))[0],
    )
    told = a.select("key", "member", F.explode(F.arrays_zip(F.col("days.date").alias("date"), both["levels"].alias("value"))).alias("x"))
    return told.select("key", "member", "x.date", "x.value")


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """(key, days, mean_abs, mean, most) of two rolls' medians over members by day: differences ``one`` less ``other``."""
    mid = lambda df, name: df.groupBy("key", "date").agg(F.median("value").alias(name))
    d = mid(one, "a").join(mid(other, "b"), ["key", "date"]).withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("days"), F.avg(F.abs("d")).alias("mean_abs"), F.avg("d").alias("mean"), F.max(F.abs("d")).alias("most"))


def backtest(history: DataFrame, method: str, origins: DataFrame, horizon: int) -> DataFrame:
    """(key, origin, lead, error, persistence) for each (key, origin): the roll from an origin, driven by what came, fitted on rows up to the origin only,
    against the level at the origin kept. Each origin is a key of its own, so all are fitted and rolled at once."""
    pair = F.struct("key", "origin")
    known = history.join(origins.select("key", "origin"), "key")
    known = known.withColumn("_pair", F.xxhash64(F.to_json(pair)))
    past = known.filter(F.col("date") <= F.col("origin")).drop("key").withColumnRenamed("_pair", "key")
    ahead = known.filter((F.col("date") > F.col("origin")) & (F.datediff("date", "origin") <= horizon)).withColumns({"member": F.lit(0), "lead": F.datediff("date", "origin")})
    w = Window.partitionBy("key").orderBy("date")
    moves = past.withColumn("change", F.coalesce(F.when(F.datediff("date", F.lag("date").over(w)) == 1, F.col("value") - F.lag("value").over(w)), F.lit(0.0)))
    seeds = moves.groupBy("key").agg(F.max_by("value", "date").alias("level"), F.max_by("change", "date").alias("change"))
    rolled = roll(ahead.select(F.col("_pair").alias("key"), "member", "date", "recharge", "season_sin", "season_cos"), fit(past, method), seeds, method)
    both = ahead.select("key", "origin", "lead", "date", "value", "_pair").join(rolled.select(F.col("key").alias("_pair"), "date", F.col("value").alias("_rolled")), ["_pair", "date"]).join(seeds.select(F.col("key").alias("_pair"), F.col("level").alias("_seed")), "_pair")
    return both.select("key", "origin", "lead", (F.col("_rolled") - F.col("value")).alias("error"), (F.col("_seed") - F.col("value")).alias("persistence"))


def gate(errors: DataFrame, least: int = 3) -> DataFrame:
    """(key, origins, mae, mae_persistence, skill, passes) of a backtest: passes with ``least`` origins and errors under persistence's."""
    own = errors.groupBy("key").agg(F.countDistinct("origin").alias("origins"), F.avg(F.abs("error")).alias("mae"), F.avg(F.abs("persistence")).alias("mae_persistence"))
    skill = 1 - F.try_divide("mae", "mae_persistence")
    return own.withColumn("skill", skill).withColumn("passes", (F.col("origins") >= least) & F.coalesce(skill > 0, F.lit(False)))


def hindcast_summary(errors: DataFrame, horizon: int) -> DataFrame:
    """(method, mae, mae_strong, mae_rising, mae_quiescent, mae_last, bias_slope) of (method, regime, lead, error): the slope is that of the mean error by lead."""
    size = F.abs("error")
    own = errors.groupBy("method").agg(F.avg(size).alias("mae"), *[F.avg(F.when(F.col("regime") == r, size)).alias(f"mae_{r}") for r in ("strong", "rising", "quiescent")], F.avg(F.when(F.col("lead") == horizon, size)).alias("mae_last"))
    by_lead = errors.groupBy("method", "lead").agg(F.avg("error").alias("bias"))
    slope = by_lead.groupBy("method").agg(F.when(F.count(F.lit(1)) > 1, F.regr_slope("bias", "lead")).otherwise(0.0).alias("bias_slope"))
    return own.join(slope, "method")
