import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark():
    from rillet.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    """Values that compare alike in both engines."""
    import datetime
    import decimal
    import math

    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Hold a query against its SQL, rows in any order."""

    def check(f, sql):
        df = f(spark, sf_dir)
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        own = sorted(repr(tuple(map(plain, x))) for x in df.collect())
        other = sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
        assert own == other

    return check
