"""Language ID by Bayesian evidence fusion.

log P(language | all) = log P(language | host) + log P(text | language) + log P(declared tag | language) + constant, where

- the text's likelihood comes from byte trigrams hashed to BUCKETS, trained on labelled documents; as trigrams hang together, a long text
  counts as EFFECTIVE of them;
- what a declared markup language says is counted: texts' own posteriors summed by declared tag;
- a host's prior is smoothed level by level: global, address suffix, domain, host, each being its counts plus SMOOTH times its parent.
  Counts are sums of the texts' own posteriors, by grouped aggregation, and a row's own share is taken out of its host's before it is judged.

One class more stands for all that is in no known language: other languages and noise. Its trigrams are half the square roots of all languages' shares
(letters that go together anywhere) and half alike, its share is UNKNOWN before anything is seen, and it has counts by host and tag as languages have. Of any language's own
trigrams STRAY are of that kind too, so that addresses, keys and names within a text don't outvote its words.

A row is rejected if its text holds no letters, or if that class is likelier than all languages together. The fit uses a documented bound of labelled
rows, TRAIN a language (by a hash of the id, about so many); all counts cover all rows.

Defined cases: null and empty texts are rejected with language null, as is what is in no known language; a null host, suffix or tag gives no evidence of its
own level; without labelled rows everything is rejected; rows that repeat count each time; extra columns stay and those that clash with the added ones give way.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, apart, is_small, load

TRAIN, BUCKETS, EFFECTIVE, SMOOTH, UNKNOWN, STRAY, TAG = 3000, 1 << 14, 100, 20.0, 0.01, 0.1, 0.5
ADDED = ("language", "posterior", "kept")
#: Everything in ASCII that is no letter becomes a blank.
BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: What isn't closed ends at the next tag or with the page, so that no start is looked for twice.
MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1|$)|<!--.*?(?:-->|$)|<[^<>]*>?|&#?\w+;", re.S | re.I)


def trigrams(text: str | None, markup: bool) -> np.ndarray:
    """Buckets of the text's byte trigrams: lower case, letters only, words parted by one blank."""
    text = text or ""
    if markup:
        text = MARKUP.sub(" ", text)
    letters = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(BLANK).split())
    if not letters:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


def _count(languages: list[str]):
    at = {n: i for i, n in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, language in zip(b.column(0), b.column(1).to_pylist()):
                total[at[language]] += np.bincount(trigrams(text.as_py(), False), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return count


def log_shares(counts: np.ndarray) -> np.ndarray:
    """(BUCKETS, languages + 1) log likelihoods of (languages, BUCKETS) counts, that of the unknown last."""
    smooth = counts + 0.5
    shares = smooth / smooth.sum(1, keepdims=True)
    root = np.sqrt(shares.mean(0))
    unknown = root / root.sum() / 2 + 0.5 / BUCKETS
    return np.log(np.concatenate([(1 - STRAY) * shares + STRAY * unknown, [unknown]])).T.copy()


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang") -> dict:
    """Log likelihoods of buckets by language, from labelled rows. Languages are told apart by their labels: one row a label reaches the driver."""
    scratch = Scratch(docs.sparkSession, "languages")
    rows = docs.filter(F.col(language).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(language).count().orderBy(language).collect()}
    languages = list(sizes)
    if not languages:
        return {"languages": [], "logs": np.zeros((BUCKETS, 0))}
    # A row is taken by a hash of its id, at its language's own rate: TRAIN rows a language on average, and all of a smaller one.
    rates = F.create_map(*[F.lit(x) for n, k in sizes.items() for x in (n, int(min(1.0, TRAIN / k) * (1 << 30)))])
    chosen = rows.filter(F.pmod(F.xxhash64(id), F.lit(1 << 30)) < F.element_at(rates, F.col(language)))
    own = scratch.table(chosen.select(F.col(text).alias("text"), F.col(language).alias("language")), "texts").coalesce(8)
    counts = sum(np.frombuffer(r[0], np.int64).reshape(-1, BUCKETS) for r in own.mapInArrow(_count(languages), "counts binary").toLocalIterator())
    return {"languages": languages, "logs": log_shares(counts)}


def likelihoods(text: Column, model: dict, markup: bool = False) -> Column:
    """array<double>: log likelihood by language, then that of the unknown; null where the text holds no letters."""
    logs = model["logs"]

    @F.arrow_udf(T.ArrayType(T.DoubleType(), False))
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            g = trigrams(t.as_py(), markup)
            # A bincount first: the table has BUCKETS rows, however long the text.
            out.append(None if not len(g) else (np.bincount(g, minlength=BUCKETS) @ logs / len(g) * min(len(g), EFFECTIVE)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return of(text)


def _softmax(logits: list[Column]) -> list[Column]:
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = [F.exp(x - most) for x in logits]
    total = reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """``evidence`` (host, domain, suffix, declared, ll and others) with language, posterior (of the language) and kept."""
    spark, known = evidence.sparkSession, len(languages)
    if not known:
        return evidence.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "kept": F.lit(False)}).drop("ll")
    k = known + 1
    start = [(1 - UNKNOWN) / known] * known + [UNKNOWN]
    scratch = Scratch(spark, "fusion")
    own = [f"q{i}" for i in range(k)]
    # Evidence that holds no likelihood of the unknown takes it for impossible.
    ll = [F.col("ll")[i] for i in range(known)] + [F.coalesce(F.get("ll", F.lit(known)), F.lit(-1e9))]
    alone = _softmax([ll[i] + float(np.log(start[i])) for i in range(k)])
    rows = scratch.table(evidence.withColumns({q: F.when(F.col("ll").isNotNull(), a).otherwise(p) for q, a, p in zip(own, alone, start)}), "alone")
    sums = lambda by, prefix: rows.filter("ll is not null").groupBy(*by).agg(*[F.sum(q).alias(f"{prefix}{i}") for i, q in enumerate(own)])
    # Priors from the top down; each level is one row a group.
    everywhere = sums([], "g")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"g{i}"), F.lit(0.0)) for i in range(k)])
    table = everywhere.select(*[((F.coalesce(F.col(f"g{i}"), F.lit(0.0)) + k * start[i]) / (total + k)).alias(f"p{i}") for i in range(k)])
    first = table.head()
    parent, keys = None, []
    for name in ("suffix", "domain", "host"):
        counted = sums([*keys, name], "n")
        up = [F.lit(float(first[i])) if parent is None else F.col(f"p{i}") for i in range(k)]
        joined = counted if parent is None else counted.join(parent, reduce(lambda a, b: a & b, [counted[c].eqNullSafe(F.col(f"_{c}")) for c in keys]))
        n = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(k)])
        kept = [] if name != "host" else [*[F.col(f"n{i}") for i in range(k)], *[u.alias(f"u{i}") for i, u in enumerate(up)]]
        keys = [*keys, name]
        parent = joined.select(*[F.col(c).alias(f"_{c}") for c in keys], *kept, *[((F.col(f"n{i}") + SMOOTH * up[i]) / (n + SMOOTH)).alias(f"p{i}") for i in range(k)])
        parent = scratch.table(parent, name)
    tags = scratch.table(sums(["declared"], "t").filter("declared is not null").withColumnRenamed("declared", "_tag"), "tags")
    by_language = tags.agg(F.count(F.lit(1)), *[F.sum(f"t{i}") for i in range(k)]).head()
    said = tags.select("_tag", *[F.log((F.col(f"t{i}") + TAG) / F.lit((by_language[i + 1] or 0.0) + TAG * (by_language[0] + 1))).alias(f"t{i}") for i in range(k)])
    side = lambda df: F.broadcast(df) if is_small(df) else df
    hosts = side(parent)
    judged = rows.join(hosts, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(hosts[f"_{c}"]) for c in keys]), "left").join(F.broadcast(said) if is_small(tags) else said, rows["declared"] == said["_tag"], "left")
    # The row's own posterior leaves its host's counts.
    counts = [F.greatest(F.col(f"n{i}") - F.when(F.col("ll").isNotNull(), F.col(own[i])).otherwise(0.0), F.lit(0.0)) for i in range(k)]
    n = reduce(lambda a, b: a + b, counts)
    prior = [F.coalesce(F.log((counts[i] + SMOOTH * F.col(f"u{i}")) / (n + SMOOTH)), F.lit(float(np.log(first[i])))) for i in range(k)]
    fused = _softmax([prior[i] + F.coalesce(ll[i], F.lit(0.0)) + F.coalesce(F.col(f"t{i}"), F.lit(0.0)) for i in range(k)])
    judged = judged.withColumns({f"f{i}": x for i, x in enumerate(fused)})
    best = [F.struct(F.col(f"f{i}").alias("p"), F.lit(name).alias("l")) for i, name in enumerate(languages)]
    out = judged.withColumn("_best", F.greatest(*best) if known > 1 else best[0])
    out = out.withColumn("kept", F.col("ll").isNotNull() & (F.col(f"f{known}") <= 0.5))
    out = out.withColumns({"language": F.when(F.col("kept"), F.col("_best.l")), "posterior": F.when(F.col("kept"), F.col("_best.p"))})
    return out.select(*[c for c in evidence.columns if c != "ll"], *ADDED)


def host_parts(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#:]*)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def declared(page: Column) -> Column:
    """The first part of the tag in <html lang=...>, lower-cased."""
    tag = F.lower(F.regexp_extract(page, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.when(tag != "", tag)


def document_evidence(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Documents have a source for a host, and neither address nor markup."""
    return docs.select(F.col(id).alias("doc_id"), F.col(host).alias("host"), F.col(host).alias("domain"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"), likelihoods(F.col(text), model).alias("ll"))


def page_evidence(pages: DataFrame, model: dict) -> DataFrame:
    return pages.select("page_id", *[c.alias(n) for n, c in host_parts(F.col("url")).items()], declared(F.col("html")).alias("declared"), likelihoods(F.col("html"), model, True).alias("ll"))


def identify(docs: DataFrame, model: dict | None = None, id: str = "doc_id", text: str = "text", host: str = "source", language: str = "lang") -> DataFrame:
    """(id, language, posterior, kept) of documents."""
    model = model or train(docs, id, text, language)
    return fuse(document_evidence(docs, model, id, text, host), model["languages"]).select(F.col("doc_id").alias(id), *ADDED)


def known_only(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", language: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language isn't identified. A row without an id is judged by its text alone."""
    own = {"doc_id": id, "text": text, "source": host, "lang": language}
    return apart(docs, lambda d: _known_only(d, *own), own, ())


def _known_only(docs: DataFrame, id: str, text: str, host: str, language: str) -> DataFrame:
    gone = identify(docs.select(id, text, host, language), None, id, text, host, language).filter(~F.col("kept") & F.col(id).isNotNull())
    gone = Scratch(docs.sparkSession, "rejected").table(gone.select(F.col(id).alias("_id")).distinct(), "ids")
    kept = docs.join(F.broadcast(gone) if is_small(gone) else gone, F.col(id) == F.col("_id"), "left_anti")
    return kept.filter(F.col(id).isNotNull() | F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents and all pages; doc_id is null for pages and page_id for documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = train(docs)
    told = fuse(document_evidence(docs, model).withColumn("page_id", F.lit(None).cast("long")).unionByName(page_evidence(load(spark, sf_dir, "pages"), model).withColumn("doc_id", F.lit(None).cast("long"))), model["languages"])
    return told.select("doc_id", "page_id", *ADDED)
