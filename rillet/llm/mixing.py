"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is ``share`` of all words times its weight's part, at most ``cap`` times the source's size, what is above
being shared anew by weight. A document is then taken floor(target / size of source) times and once more with the
fractional rest as its inclusion probability. The cube's flight moves the probabilities of three documents at a time along
the null space of the two constraints (words, documents) until one of them is 0 or 1, so both totals stay what they are;
large documents fly first. LANDING documents of a source, evenly spread over its sizes, don't fly; landing tries all subsets of these
and the two undecided ones and takes the one nearest in words, its number of documents being off by less than one.

The flight runs in chunks of a source (by hash of id and text, CHUNK documents on average), which leaves two documents each; these
fly again, chunked anew, until a source's rest fits one chunk: levels grow with the logarithm of the largest source, and a source
with a third of all rows is many chunks. Random choices are hashes of (source, level, chunk), so reruns agree.

Defined cases: a null text has no words; an empty document is taken with 0 words; documents with a null source are a source, the last
in order; ties in size fly by id, null ids first; rows that repeat an id are documents of their own here, while ``mixed``, which joins by id,
takes them alike; a document that holds most of its source's words limits how near the source can come to its target, as copies are whole; an empty table gives an empty result; columns that clash with the added ones give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, apart, is_small, load

WEIGHTS, SHARE, CAP, CHUNK, LANDING = (3.0, 1.0, 2.0), 1.5, 2.0, 2048, 12
STATE = "id long, print long, s long, size long, whole long, p double, chunk long"


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, s, rows, source_size, target) of (source, rows, source_size): one row a source, in one window.

    Sources fill up in order of cap / weight; one is full if its cap is under what its weight would get of the rest."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    own = totals.withColumns({"s": n.cast("long"), "w": weight, "most": cap * F.col("source_size")})
    filling = Window.orderBy(F.col("most") / F.col("w"), "s")
    all_, before = Window.partitionBy(), filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = share * F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    own = own.withColumn("level", rest / left).withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), "s", "level"))).over(all_)["level"]
    return own.select("source", "s", "rows", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Probabilities moved until two at most are neither 0 nor 1; sums of p and of p * size stay."""
    p = p.astype(float).tolist()
    z = size.tolist()
    draw = iter(draws.random(4 * len(p) + 8).tolist())
    live: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(live, u) if x)
            down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(live, u) if x)
            step = up if next(draw) * (up + down) < down else -down
            for k, x in zip(live, u):
                p[k] += step * x
                if p[k] < 1e-9:
                    p[k] = 0.0
                elif p[k] > 1 - 1e-9:
                    p[k] = 1.0
            live = [k for k in live if 0 < p[k] < 1]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """0 or 1 for each undecided document, LANDING + 2 at most: of all subsets the nearest in words, then in documents, among
    those whose number of documents is off by less than one."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    if len(open_):
        sets = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        documents = np.abs(sets.sum(1) - p[open_].sum())
        sets, documents = sets[documents < 1], documents[documents < 1]
        off = np.abs(sets @ size[open_] - p[open_] @ size[open_]).round(6)
        p[open_] = sets[np.lexsort((documents, off))[0]]
    return p


def _flight(level: int, last: bool):
    def flight(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("id", "ascending"), ("print", "ascending")])
        s, chunk = (k.as_py() for k in key)
        size, p = rows["size"].to_numpy(), rows["p"].to_numpy().copy()
        flies = np.ones(len(p), bool)
        if last:
            flies[np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int)] = False
        p[flies] = fly(size[flies], p[flies], np.random.default_rng([s, level, chunk]))
        if last:
            p = land(size, p)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return flight


def decide(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row: copies is how often the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.table(docs.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), F.xxhash64(id, text).alias("print"), words(F.col(text)).alias("size")), "sizes")
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    aims = scratch.table(targets(totals, weights, share, cap), "targets")
    side = F.broadcast(aims) if is_small(aims) else aims
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    chunks = F.ceil(F.col("rows") / F.lit(CHUNK))
    state = sizes.join(side, sizes["source"].eqNullSafe(aims["source"])).select(
        "id", "print", "s", "size", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"), F.pmod("print", chunks).alias("chunk")
    )
    decided, level, open_ = [], 0, F.col("p").between(1e-12, 1 - 1e-12)
    while True:
        # The largest chunk tells whether this level is the last: each source is one chunk then.
        last = state.agg(F.max("chunk")).head()[0] in (None, 0)
        flown = scratch.table(state.groupBy("s", "chunk").applyInArrow(_flight(level, last), STATE), f"flown-{level}")
        decided.append(flown if last else flown.filter(~open_))
        if last:
            break
        rest = flown.filter(open_)
        counts = rest.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        level += 1
        state = rest.drop("chunk").join(F.broadcast(counts) if is_small(aims) else counts, "s").withColumn("chunk", F.pmod(F.xxhash64("print", F.lit(level)), F.ceil(F.col("n") / F.lit(CHUNK)))).select("id", "print", "s", "size", "whole", "p", "chunk")
    rows = decided[0]
    for more in decided[1:]:
        rows = rows.union(more)
    copies = F.col("whole") + F.round("p").cast("long")
    return rows.join(side, "s").select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs``, each row as often as the mix takes it."""
    return apart(docs, lambda d: _mixed(d, "doc_id", "source", "text", weights, share, cap), {"doc_id": id, "source": source, "text": text}, ())


def _mixed(docs: DataFrame, id: str, source: str, text: str, weights, share: float, cap: float) -> DataFrame:
    own = decide(docs.select(id, source, text), id, source, text, weights, share, cap)
    own = Scratch(docs.sparkSession, "mixed").table(own.groupBy(F.col(id).alias("_id")).agg(F.min("copies").cast("int").alias("_copies")), "copies")
    joined = docs.join(F.broadcast(own) if is_small(own) else own, F.col(id).eqNullSafe(F.col("_id"))).filter("_copies > 0")
    return joined.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents."""
    return decide(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("copies")
