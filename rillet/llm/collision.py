"""Nearest neighbours by collision counting: sorted single projections, query-centred windows, virtual rehashing.

1. Equal vectors are one point; of a point's ids the first TOP + 1 can matter, as ties go to smaller ids, and a bounded window keeps just those.
2. Points go to shards by hash, PER_SHARD or SHARD_BYTES at most. A task gets a shard's points ahead of its part of the query points and indexes
   them all: vectors of a shard are lifted to one length, so that the largest inner product is the least distance, and projected on random
   directions, each of which is kept as a sorted array. Building that takes about as long as reading it, so a shard moves as its vectors.
3. A query's projections are the centres of windows, one an array. Windows grow by GROW a round; a point's collisions are counted as windows
   reach it, and a point with enough of them is verified: by the product of unit vectors in single precision, and what can be among the nearest
   by the inner product in double precision. The number of arrays and the collisions asked for follow from the tails of the count: a point at
   the radius collides often enough but for ERROR of cases, one RATIO times as far in FALSE of cases. A query ends when it has k points
   within ``slack`` times the radius.
4. Each batch audits itself: AUDITED of its queries are compared with the whole shard, and while they miss more than 1 - AUDIT of what is nearest,
   slack shrinks for all of the batch; at zero windows grow until they hold every point. Where neighbours are hardly nearer than the rest, as in
   noise, windows hold most of the shard and a query costs as much as a scan.
5. Answers of the shards meet in one bounded window a query point, then points become ids again.

Candidates have no cap: each point with enough collisions is verified. Memory is a shard and a batch.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors of different
length don't meet; equal rows count once; an id with several vectors asks with each of them and meets none of its own; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, load

TOP, EVERY = 20, 20
PER_SHARD, SHARD_BYTES, QUERIES = 100_000, 64 << 20, 256
RATIO, ERROR, FALSE, GROW, SLACK, LESS = 2.0, 0.05, 0.05, 1.2, 1.2, 0.9
AUDITED, AUDIT = 8, 0.95
#: Half the window at radius one, as the method's authors derive it from the ratio.
HALF = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1)) / 2


def _collides(distance: float) -> float:
    """The share of directions along which points so far apart, at radius one, are within half a window."""
    return math.erf(HALF / distance / math.sqrt(2))


@lru_cache
def arrays_for(error: float = ERROR, false: float = FALSE) -> tuple[int, int]:
    """(arrays, collisions asked for): the fewest arrays with which a point at the radius collides often enough but for ``error`` of cases, and one
    RATIO times as far in ``false`` of cases at most."""
    near, far = _collides(1), _collides(RATIO)
    tail = lambda m, l, p: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(l, m + 1))
    return next((m, l) for m in count(1) for l in range(m, 0, -1) if tail(m, l, near) >= 1 - error and tail(m, l, far) <= false)


class Arrays:
    """All points of a shard, sorted along each direction."""

    def __init__(self, x: np.ndarray, tie: np.ndarray, seed: int = 0):
        """x: (n, d) vectors; tie: their order where products are equal."""
        self.x, self.tie = x, tie
        self.m, self.asked = arrays_for()
        self.length = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
        self.unit = (x / self.length).astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - (self.unit**2).sum(1, dtype=np.float32)))
        self.directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, self.m), dtype=np.float32)
        along = np.ascontiguousarray((self.unit @ self.directions[:-1] + rest[:, None] * self.directions[-1]).T)
        self.order = np.argsort(along, axis=1, kind="stable").astype(np.int32)
        self.along = np.take_along_axis(along, self.order, 1)

    def products(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.x[at].astype(np.float64) * q.astype(np.float64)).sum(1)

    def _best(self, about: np.ndarray, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the k largest, ties by ``tie``. ``about``: products of unit vectors in single precision, which leave out what
        can't be among them."""
        if len(at) > k:
            at = at[about >= np.partition(about, len(at) - k)[len(at) - k] - 1e-5]
        exact = self.products(at, q)
        order = np.lexsort((self.tie[at], -exact))[:k]
        return at[order], exact[order]

    def search(self, q: np.ndarray, k: int, slack: float, radius: float = 2**-5) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and products of its k nearest found, nearest first. ``radius``: of the first round."""
        n, unit = len(self.x), (q / np.linalg.norm(q.astype(np.float64), axis=1)[:, None]).astype(np.float32)
        centre = (unit @ self.directions[:-1]).T
        hits, seen = np.zeros((len(q), n), np.int16), [(np.empty(0, np.int64), np.empty(0, np.float32))] * len(q)
        low = np.stack([np.searchsorted(a, c) for a, c in zip(self.along, centre)])
        high, live, found = low.copy(), np.arange(len(q)), [None] * len(q)
        while len(live):
            left = np.stack([np.searchsorted(a, c - HALF * radius, "left") for a, c in zip(self.along, centre[:, live])])
            right = np.stack([np.searchsorted(a, c + HALF * radius, "right") for a, c in zip(self.along, centre[:, live])])
            going = []
            for j, i in enumerate(live):
                l0, l1, r0, r1 = left[:, j].tolist(), low[:, i].tolist(), high[:, i].tolist(), right[:, j].tolist()
                new = [o[a:b] for o, a, b in zip(self.order, l0, l1) if a < b] + [o[a:b] for o, a, b in zip(self.order, r0, r1) if a < b]
                at, about = seen[i]
                if new:
                    before = hits[i] >= self.asked
                    hits[i] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                    fresh = np.flatnonzero((hits[i] >= self.asked) & ~before)
                    if len(fresh):
                        at, about = np.r_[at, fresh], np.r_[about, self.unit[fresh] @ unit[i]]
                        seen[i] = at, about
                last = 1 - (slack * radius) ** 2 / 2  # the product at the distance at which the search may end
                if len(at) >= n or np.count_nonzero(about >= last) >= k:
                    found[i] = self._best(about, at, q[i], k)
                else:
                    going.append(i)
            low[:, live], high[:, live] = np.minimum(left, low[:, live]), np.maximum(right, high[:, live])
            live, radius = np.array(going, np.int64), radius * GROW
        return found

    def exact(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        unit = (q / np.linalg.norm(q.astype(np.float64))).astype(np.float32)
        return self._best(self.unit @ unit, np.arange(len(self.x)), q, k)

    def audited(self, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` with the slack at which a sample of the queries finds what a full scan finds, from the radius at which the first could end."""
        sample, slack = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(np.int64)), SLACK
        truth = [self.exact(q[i], k) for i in sample]
        size = np.linalg.norm(q[sample].astype(np.float64), axis=1) * self.length
        far = min(math.sqrt(max(1e-4, 2 - 2 * score[-1] / s)) for (_, score), s in zip(truth, size))
        while slack > 0:
            found = self.search(q[sample], k, slack, far / slack / GROW)
            if np.mean([np.isin(t, f).mean() for (t, _), (f, _) in zip(truth, found)]) >= AUDIT:
                break
            slack = slack * LESS if slack > 0.2 else 0.0
        return self.search(q, k, slack, far / max(slack, 0.1) / GROW)


def _vectors(column, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]).reshape(-1, dim)


def _answers(k: int):
    """Rows sorted by (dim, shard, salt), points ahead of queries, to (q1, q2, p1, p2, least, score)."""
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])

    def told(index: Arrays, points: pa.Table, asked: pa.RecordBatch, dim: int):
        q = _vectors(asked.column("v"), dim)
        rows = [(np.full(len(at), i), at, score) for i, (at, score) in enumerate(index.audited(q, k))]
        who, at, score = (np.concatenate(c) for c in zip(*rows))
        pick = lambda t, name, i: t.column(name).to_numpy()[i]
        columns = [pick(asked, "h1", who), pick(asked, "h2", who), pick(points, "h1", at), pick(points, "h2", at), pick(points, "least", at), score]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def answers(batches):
        now, held, index, points = None, [], None, None
        for b in batches:
            keys = np.stack([b.column(n).to_numpy() for n in ("dim", "shard", "salt", "asks")], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                if end == start:
                    continue
                *key, asks = keys[start].tolist()
                if key != now:
                    now, held, index, points = key, [], None, None
                rows = b.slice(start, end - start)
                if not asks:
                    held.append(rows)
                elif held or index:
                    if index is None:
                        points, held = pa.Table.from_batches(held).combine_chunks(), []
                        index = Arrays(_vectors(points["v"], key[0]), points["least"].to_numpy())
                    for at in range(0, rows.num_rows, QUERIES):
                        yield told(index, points, rows.slice(at, QUERIES), key[0])

    return answers


def nearest(table: DataFrame, asks=None, id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks`` (a condition; default: all) the ``top`` other rows with the largest inner
    product found, ties to the smaller id. ``rank`` is an int from 1."""
    spark = table.sparkSession
    scratch = Scratch(spark, "nearest")
    v = F.col(vector)
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (c * 0 == 0)) & F.exists(v, lambda c: c != 0), F.lit(False)) & F.col(id).isNotNull()
    rows = table.filter(sound).select(F.col(id).cast("long").alias("id"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), v.alias("v"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"))
    rows = scratch.table(rows, "rows")
    points = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("asks").alias("asks"), F.first("v").alias("v")).withColumn("dim", F.size("v"))
    points = scratch.table(points, "points")
    first = lambda df, by, order, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
    ids = first(rows.select("h1", "h2", "id").distinct(), ("h1", "h2"), ("id",), top + 1).select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("id").alias("vec_id"))
    n, width, queries = points.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).head()
    shards = max(1, -(-n // PER_SHARD), -(-n * 8 * width // SHARD_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(-(-tasks // shards), -(-queries // QUERIES)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    number = lambda seed, k: F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(k)).cast("int")
    there = points.select("dim", number(5, shards).alias("shard"), every(salts).alias("salt"), F.lit(0).alias("asks"), "h1", "h2", "least", "v")
    asked = points.filter("asks").select("dim", every(shards).alias("shard"), number(7, salts).alias("salt"), F.lit(1).alias("asks"), "h1", "h2", "least", "v")
    dealt = there.union(asked).repartition(shards * salts, "dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "asks", "h1", "h2")
    answers = scratch.table(dealt.mapInArrow(_answers(top + 1), "q1 long, q2 long, p1 long, p2 long, least long, score double"), "answers")
    best = first(answers, ("q1", "q2"), (F.desc("score"), "least"), top + 1).select("q1", "q2", "p1", "p2", "score")
    # A query point's answers as ids: the own id may be among them, so one more than asked for.
    named = first(best.join(ids, ["p1", "p2"]), ("q1", "q2"), (F.desc("score"), "vec_id"), top + 1).select("q1", "q2", "vec_id", "score")
    named = scratch.table(named, "named")
    who = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    met = who.join(named, ["q1", "q2"]).filter("query_id <> vec_id")
    return first(met, ("query_id", "q1", "q2"), (F.desc("score"), "vec_id"), top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all embeddings; rows whose id is divisible by 20 ask for their 20 nearest."""
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % EVERY == 0)
