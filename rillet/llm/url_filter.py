"""URL filters: pattern rules that are indexed by their rarest literal token.

A rule names literal tokens that every url it fits must hold, and a regular expression. The index holds each rule under
the one of its tokens that is rarest among all urls (counted first, over the rules' own tokens only); a url's tokens
fetch candidate rules, and only those run their expressions. So the work a url costs follows its few candidates and not
the number of rules. Both passes are per row; the one shuffle sums counts of rule tokens.

Defined cases: a null url and one without ``://`` have empty host and path and fit nothing, so they are allowed; equal
urls are judged alike; columns that clash with the added ones give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile("[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path, host lower-cased. Among fitting rules the greatest ``weight`` wins;
    ``listed`` rules (a host and a path) come before patterns."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = False

    @cached_property
    def search(self):
        return re.compile(self.pattern).search


def listed(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and for paths that start with ``path``; the longest such rule wins."""
    # The last part of a path may go on in the url, so it's no whole token there unless a sign ends it.
    whole = re.sub("[A-Za-z0-9]+$", "", path)
    tokens = TOKEN.findall(f"{host}/{whole}".translate(LOWER))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)), len(host + path), True)


#: The listed rules of the contract.
LISTED = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words that whole hosts of spam, adult, gambling and advert sites are named by; each stands between signs.
HOST_WORDS = (
    "spam cheap+pills pills viagra cialis pharmacy+online porn xxx adult+videos escort casino poker slots betting jackpot payday+loans replica+watches "
    "doubleclick adserver adservice popads clickbait phishing malware torrent warez"
)
#: Path parts of pages that hold no prose.
PATH_WORDS = "wp-login wp-admin cgi-bin"


def _host_word(words: str) -> Rule:
    parts = words.split("+")
    return Rule(f"host:{words}", "block", rf"^[^/]*(?<![a-z0-9]){'[^a-z0-9/]+'.join(map(re.escape, parts))}(?![a-z0-9])[^/]*(?:/|$)", tuple(parts), 0)


RULES = (
    *(listed(v, h, p) for v, h, p in LISTED),
    *(_host_word(w) for w in HOST_WORDS.split()),
    *(Rule(f"path:{w}", "block", rf"(?s)^[^/]*/(?:.*/)?{re.escape(w)}(?:[/.]|$)", tuple(TOKEN.findall(w)), 0) for w in PATH_WORDS.split()),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty for null or without ``://``."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = re.match(r"[^?#]*", rest[end:])[0]
    return rest[:end].translate(LOWER), path


class Index:
    def __init__(self, rules, counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
            self.by_token.setdefault(rarest, []).append(r)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str | None, str]:
        """host, path, listed rule, pattern rule, verdict."""
        host, path = parts(url)
        at = f"{host}{path}"
        best = {True: None, False: None}
        for token in set(TOKEN.findall(at.translate(LOWER))):
            for r in self.by_token.get(token, ()):
                # Patterns are met in any order: the heaviest wins, of equals the first by name.
                if ((b := best[r.listed]) is None or (-r.weight, r.name) < (-b.weight, b.name)) and r.search(at):
                    best[r.listed] = r
        rule, pattern = best[True], best[False]
        return host, path, rule and rule.name, pattern and pattern.name, (rule or pattern).verdict if rule or pattern else "allow"


def token_counts(urls: DataFrame, url: str, rules) -> dict[str, int]:
    """Urls that hold each of the rules' tokens; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    lower = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_intersect(F.split(lower, "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    return {r[0]: r[1] for r in urls.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()}


def judge(urls: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``urls`` with host, path, rule (the listed rule that decides, else null), pattern (the pattern that fits) and verdict."""
    from .common import apart

    rules = tuple(rules)
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    names = [n for n in ("host", "path", "rule", "pattern", "verdict") if n != url]
    index = Index(rules, token_counts(urls, url, rules))
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "pattern", "verdict")])

    @F.arrow_udf(kind)
    def told(given: pa.Array) -> pa.Array:
        seen = [index.judge(u) for u in given.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([s[i] for s in seen], pa.string()) for i in range(5)], names=list(kind.names))

    add = lambda d: d.withColumn("told", told(F.col("url"))).select("*", *[F.col(f"told.{n}").alias(n) for n in names])
    return apart(urls, add, {"url": url}, tuple(names))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the url of every page."""
    from .common import load

    return judge(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = " UNION ALL ".join(f"SELECT '{h + p}' AS rule, '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in LISTED)
    word = "|".join("[^a-z0-9/]+".join(w.split("+")) for w in HOST_WORDS.split())
    path = "|".join(PATH_WORDS.split())
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules AS ({fits}
), hits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({word})($|[^a-z0-9])')
  OR regexp_matches(path, '(?s)^/(.*/)?({path})([/.]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits USING (page_id)
"""


SQL = _sql()
