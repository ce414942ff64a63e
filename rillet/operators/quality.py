"""Quality control: fences, caps and drops, with a key's statistics joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def iqr_bounds(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """(key, lo, hi, n) around the median; a key without spread has no fence."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(key).agg(q.alias("q"), F.count(value).alias("n"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return s.select(key, F.when(iqr > 0, F.col("q")[1] - k * iqr).alias("lo"), F.when(iqr > 0, F.col("q")[1] + k * iqr).alias("hi"), "n")


def iqr_fence(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """``value`` null where it is outside its key's fence."""
    out = df.join(iqr_bounds(df, key, value, k), key)
    return out.withColumn(value, F.when((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")), None).otherwise(F.col(value))).select(*df.columns)


def tail_screen(new: DataFrame, history: DataFrame, key: str, value: str, k: float = 3.0, least: int = 4) -> DataFrame:
    """The rows of ``new`` that are inside the fence of their key's ``history``; short histories let all pass."""
    out = new.join(iqr_bounds(history, key, value, k), key, "left")
    return out.filter((F.coalesce("n", F.lit(0)) < least) | F.col("lo").isNull() | F.col(value).between(F.col("lo"), F.col("hi"))).select(*new.columns)


def zscore_cap(df: DataFrame, key: str, value: str, most: float = 10.0) -> DataFrame:
    """Rows within ``most`` standard deviations of their key's mean; keys without deviation keep all."""
    s = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    out = df.join(s, key)
    return out.filter(F.col("_s").isNull() | (F.col("_s") == 0) | (F.abs((F.col(value) - F.col("_m")) / F.col("_s")) <= most)).select(*df.columns)


def drop_keys(df: DataFrame, key: str, value: str, least_sd: float | None = None, most_mean: float | None = None) -> DataFrame:
    """Rows of keys that move at least so much and whose mean isn't over the bound."""
    s = df.groupBy(key).agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"))
    if least_sd is not None:
        s = s.filter(F.col("sd") >= least_sd)
    if most_mean is not None:
        s = s.filter(F.col("mean") <= most_mean)
    return df.join(s.select(key), key, "left_semi")
