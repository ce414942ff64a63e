"""Named queries over the test tables, each with the SQL that it is held against."""

from __future__ import annotations

from . import catalogue, ensembles, extra, more, rest, screens, series, spatial, streams, verification  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def entry(spark):
    """The flagship: current status against monthly normals."""
    return QUERIES["current_status"](spark, "/root/testdata/sf0.001")
