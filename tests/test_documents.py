"""What is published is rounded as C's printf rounds it."""

import random

from pyspark.sql import functions as F

from rillet.functions import documents


def test_fixed_rounds_the_double_and_ties_to_even(spark):
    draws = random.Random(7)
    values = [8.45, 24.15, 28.95, 0.25, 0.75, -0.25, -0.04, 0.05, 0.5, 1.5, 2.5, -3.5, 0.0, 99.95, 1e15, 1234567.25, 0.15, 0.35, 1e-300]
    values += [draws.randint(-100000, 1000000) / 100 / 100 for _ in range(3000)] + [draws.randint(-9999, 9999) / 20 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", documents.fixed(F.col("v"), 0).alias("a"), documents.fixed(F.col("v"), 1).alias("b"), documents.percent(F.col("v") / 100, 1).alias("p")).collect():
        assert (r.a, r.b, r.p) == ("%.0f" % r.v, "%.1f" % r.v, "%.1f%%" % (r.v / 100 * 100))


def test_fixed_without_a_number(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(documents.fixed(F.col("v"), 1)).head()[0] is None


def test_fixed_keeps_the_sign_of_a_zero(spark):
    values = [-0.0, 0.0, -0.04, -1e-300, float("nan"), float("inf"), float("-inf"), 2.0**49, -(2.0**52) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(documents.fixed(F.col("v"), 0), documents.fixed(F.col("v"), 1)).collect()]
    assert got == [("%.0f" % v, "%.1f" % v) for v in values]


def test_headlines_of_odd_balances_are_those_of_the_sql(spark, tmp_path):
    """Rounded to cents, a small debt is -0.0, and the threshold is told as printf tells it."""
    import duckdb

    from rillet import plans

    values = [-0.0, 0.0, -0.01, 4.99, -5.0, 845.0, None, float("nan"), float("inf"), float("-inf")]
    rows = [(k, values[k % len(values)]) for k in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(c.execute(plans.oracle_sql()["headlines"]).fetchall())
    assert {r.key: r.sentence for r in plans.queries()["headlines"](spark, str(tmp_path)).collect()} == want
    assert sum(" -0.0 mAOD" in v for v in want.values()) > 40
