"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host when it stands on more than ``ratio`` of the host's pages and on ``min_pages`` of them
at least; every copy of it on that host is dropped, elsewhere it stays. Lines are compared by a 128-bit hash of their
trimmed bytes. Cost: the lines are hashed where they lie and counted with map-side partial sums, so a line that stands on
every page of a huge host is one row a task in the shuffle; texts move only if the boilerplate set is too large to send
to every executor.

Defined cases: a null text counts as empty and stays null; blank lines are neither counted nor dropped; a null host is a
host of its own; a line repeated within a page counts once for that page; pages with the same id and text count each
time they occur; an input column named like one of the added ones gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, apart

RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines that may go to every executor: 32 bytes each, so 16 MB at most.
BROADCAST_LINES = 500_000
ADDED = ("n_lines", "n_dropped")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null where it is blank."""
    bare = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, a, b): the hashes of each host's boilerplate lines."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), _key), lambda k: k.isNotNull()))
    counted = pages.select(F.col(host).alias("host"), F.explode(keys).alias("k")).groupBy("host", "k.a", "k.b").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("total"))
    return (
        counted.filter(F.col("pages") >= min_pages)
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("pages") > ratio * F.col("total"))
        .select("host", "a", "b")
    )


def drop_boilerplate(pages: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` without its boilerplate lines in ``text``, plus n_lines (long) and n_dropped (long)."""
    return apart(pages, lambda d: _drop(d, "doc_id", "source", "text", ratio, min_pages, broadcast_lines), {"doc_id": id, "source": host, "text": text}, ADDED)


def _drop(pages: DataFrame, id: str, host: str, text: str, ratio: float, min_pages: int, broadcast_lines: int) -> DataFrame:
    found = Scratch(pages.sparkSession, "lines").table(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    small = found.limit(broadcast_lines + 1).count() <= broadcast_lines
    # One row a host that has any: its hashes as a list, a / (ratio) times a page's lines at most.
    if small:
        sets = F.broadcast(found.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("a", "b")).alias("_bad")))
        joined = pages.join(sets, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
        return _strip(joined, text)
    return _strip_by_join(pages, found, id, host, text)


def _strip(joined: DataFrame, text: str) -> DataFrame:
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: _key(x).isNull() | ~F.array_contains(F.col("_bad"), _key(x)))
    return _told(joined.withColumn("_kept", F.when(F.col("_bad").isNotNull() & F.col(text).isNotNull(), kept).otherwise(lines)), text).drop("_bad")


def _told(df: DataFrame, text: str) -> DataFrame:
    n = F.size(_lines(F.col(text))).cast("long")
    return (
        df.withColumns({"n_lines": n, "n_dropped": n - F.size("_kept")})
        .withColumn(text, F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")))
        .drop("_kept")
    )


def _strip_by_join(pages: DataFrame, found: DataFrame, id: str, host: str, text: str) -> DataFrame:
    """The way without a broadcast: line hashes meet the boilerplate set in a shuffle join, whose hot keys AQE splits, and
    each page gets back the hashes that it has to drop."""
    flat = pages.select(F.col(id).alias("_id"), F.col(host).alias("_host"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("k"))
    hits = flat.join(found.hint("shuffle_merge"), (F.col("_host").eqNullSafe(F.col("host"))) & (F.col("k.a") == F.col("a")) & (F.col("k.b") == F.col("b")))
    bad = hits.groupBy("_id", "_host").agg(F.collect_set(F.struct("a", "b")).alias("_bad"))
    joined = pages.join(bad.hint("shuffle_merge"), F.col(id).eqNullSafe(F.col("_id")) & F.col(host).eqNullSafe(F.col("_host")), "left").drop("_id", "_host")
    return _strip(joined, text)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents, a document's source as its host."""
    from .common import load

    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


_BARE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, pos, line, {_BARE} AS bare FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.bare FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.bare <> '' GROUP BY l.source, l.bare, t.total
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO} * t.total
), told AS (
  SELECT l.doc_id, l.source, count(*) AS n_lines, count(b.bare) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.bare IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare GROUP BY l.doc_id, l.source)
SELECT d.doc_id, d.source, coalesce(t.n_lines, 1) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text
FROM documents d LEFT JOIN told t USING (doc_id)
"""
