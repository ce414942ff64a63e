"""Embedding near-dedup: a navigable small-world graph of leaders, every vector compared with the vectors that live near it.

1. Equal vectors become one vertex with a weight, so that copies, however many, are one point.
2. Leaders are a sample, MOST at the most, thinned where they would link with each other. Every vector is indexed: it asks the graph of leaders for
   the nearest one, whose cell is its home, and for all that are less than a slack further: the cells that it visits. A query whose whole beam
   is within the slack is asked again with a wider one. Each batch audits itself: a few of its queries are compared with all leaders, and while they
   miss more than 1 - AUDIT the beam is doubled for all. A beam of more than WIDEST of the leaders gives way to comparing with all of them.
3. The slack is such that of pairs just over the bound, apart in a random direction or in one as the vectors themselves spread, and of the pairs in a
   sample, FOUND of them meet: one of the two visits the other's home.
4. Cells that lie together make a shard. A vector goes to the shards that it visits, and there it is compared with the cells that it visits, by matrix
   products; what is within rounding of the bound is decided in double precision. A shard's members go to as many tasks as run at once, not
   more, and each streams its part of all visitors past them, in Arrow batches. A link is counted for the visitor, and for the member too
   unless the member visits the visitor's home.
5. Of the links a batch gives a spanning forest only: components come out the same and no group is expanded into pairs.

There are SHARDS shards, fewer while they would hold less than LEAST vectors, and more when PER_SHARD vectors or SHARD_BYTES are reached; a shard that
holds more for all that, as a cell can't be cut, is dealt by hash. So memory is bounded at any size. Vectors are kept as they are stored, in single
precision if the column is.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
length link with nothing; a row with a null id takes no part, its component is null and it is kept; equal vectors link; an id that has several
vectors is linked by each of them, and n_links is told of the row's own vector; columns that clash with the added ones give way, others stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, bound_batches, is_small, load
from .components import components
from .hnsw import Graph, M

SHARDS, LEAST, PER_SHARD, SHARD_BYTES, PART = 8, 5000, 200_000, 256 << 20, 4 << 20
CELL, MOST, LEADER_BYTES, DIMS, SAMPLE, FOUND = 1024, 1024, 32 << 20, 256, 2048, 0.995
BEAM, AUDITED, AUDIT, CHUNK = 16, 48, 0.99, 256
PROBES, WIDEST = 144, 0.25
ADDED = ("n_links", "component_id", "kept")


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def ask(graph: Graph, q: np.ndarray, bound: float, beam: int, slack: float | None = None):
    """For each query the nodes over the bound, with beams that widen until the worst answer is under it. ``slack``: the bound is that much under the best."""
    out: list[np.ndarray] = [None] * len(q)
    todo, width = np.arange(len(q)), beam
    while len(todo):
        step = max(8, min(CHUNK, 60_000_000 // max(len(graph.x), M * width * q.shape[1])))
        again = []
        for at in range(0, len(todo), step):
            rows = todo[at : at + step]
            ids, sims = graph.search(q[rows], width)
            least = np.full(len(rows), bound) if slack is None else sims[:, 0] - slack
            over = (sims >= least[:, None]) & (ids >= 0)
            for r, i, o in zip(rows, ids, over):
                if width < len(graph.x) and o.all():
                    again.append(r)
                else:
                    out[r] = i[o]
        todo, width = np.array(again, np.int64), min(2 * width, len(graph.x))
    return out


def scan(graph: Graph, q: np.ndarray, bound: float, slack: float | None = None):
    """``ask`` by comparison with every node; with a slack, by falling similarity too."""
    step = max(1, 4_000_000 // len(graph.x))
    found = []
    for at in range(0, len(q), step):
        for s in q[at : at + step] @ graph.x.T:
            near = np.flatnonzero(s >= (bound if slack is None else s.max() - slack))
            found.append(near if slack is None else near[np.argsort(-s[near], kind="stable")])
    return found


def probes(x: np.ndarray, bound: float, n: int) -> np.ndarray:
    """Unit vectors that have a cosine of just over ``bound`` with a node each, in a random direction: links as hard to find as links can be."""
    at = np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(np.int64))
    away = np.random.default_rng(len(x)).standard_normal((len(at), x.shape[1]))
    away -= (away * x[at]).sum(1, keepdims=True) * x[at]
    length = np.linalg.norm(away, axis=1, keepdims=True)
    level = min(1.0, bound + 1e-4)
    return (level * x[at] + np.sqrt(1 - level**2) * away / np.maximum(length, 1e-12)).astype(np.float32)


def audited(graph: Graph, q: np.ndarray, bound: float, own: np.ndarray | None = None, slack: float | None = None):
    """``ask``, with the beam widened until a sample of the queries, and without a slack probes at the bound, find what a full scan finds. ``own``: each
    query's own node (-1: none), which is no evidence."""
    n = len(graph.x)
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(np.int64))
    asked = np.concatenate([q[sample], probes(graph.x, bound, PROBES if slack is None else 0)])
    self = np.full(len(asked), -1) if own is None else np.r_[own[sample], np.full(len(asked) - len(sample), -1)]
    truth = [t[t != i] for t, i in zip(scan(graph, asked, bound, slack), self)]
    total = np.array([sum(map(len, truth[: len(sample)])), sum(map(len, truth[len(sample) :]))])
    beam = BEAM
    while slack is not None and beam < 1.5 * total[0] / len(sample):
        beam *= 2
    while beam <= max(BEAM, WIDEST * n):
        hits = [np.isin(t, f).sum() for t, f in zip(truth, ask(graph, asked, bound, beam, slack))]
        if (np.array([sum(hits[: len(sample)]), sum(hits[len(sample) :])]) >= AUDIT * total).all():
            return ask(graph, q, bound, beam, slack)
        beam *= 2
    return scan(graph, q, bound, slack)


def thinned(x: np.ndarray, bound: float) -> np.ndarray:
    """The unit vectors that link with none kept before them."""
    kept = np.zeros(len(x), bool)
    for i in range(len(x)):
        kept[i] = not (x[:i][kept[:i]] @ x[i] >= bound).any()
    return x[kept]


def slack_for(leaders: np.ndarray, sample: np.ndarray, bound: float) -> float:
    """How much further than the nearest leader a vector has to look, for a share of FOUND of all pairs at the bound to meet."""
    r, q = np.random.default_rng(len(sample)), sample.astype(np.float64)
    level, needed = min(1.0, bound + 1e-4), []

    def gaps(a, b):
        sa, sb, i = a @ leaders.T, b @ leaders.T, np.arange(len(a))
        return np.minimum(sa.max(1) - sa[i, sb.argmax(1)], sb.max(1) - sb[i, sa.argmax(1)])

    for away in (r.standard_normal(q.shape), r.standard_normal((len(q), len(q))) @ q):
        away = away - (away * q).sum(1, keepdims=True) * q
        y = level * q + np.sqrt(1 - level**2) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        needed.append(gaps(q, y / np.linalg.norm(y, axis=1, keepdims=True)))
    i, j = np.nonzero(np.triu(sample @ sample.T >= bound, 1))
    if len(i):
        some = np.linspace(0, len(i) - 1, min(len(i), 2 * SAMPLE)).astype(np.int64)
        needed.append(gaps(q[i[some]], q[j[some]]))
    return max(float(np.quantile(g, FOUND)) for g in needed) + 1e-6


def shards_of(leaders: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """Each cell's shard: cells are halved by weight, along the line between two that are far apart, until there are enough shards."""
    out, parts = np.zeros(len(leaders), np.int64), [(np.arange(len(leaders)), shards)]
    n = 0
    while parts:
        cells, k = parts.pop()
        if k == 1 or len(cells) == 1:
            out[cells] = n
            n += 1
            continue
        x = leaders[cells]
        far = (x @ x[0]).argmin()
        cells = cells[np.argsort(x @ (x[(x @ x[far]).argmin()] - x[far]), kind="stable")]
        share = np.cumsum(weights[cells]) / weights[cells].sum()
        at = min(max(1, int(np.searchsorted(share, k // 2 / k)) + 1), len(cells) - 1)
        parts += [(cells[:at], k // 2), (cells[at:], k - k // 2)]
    return out


def _route(index: dict):
    """Each vector with its home and the cells and shards that it visits. ``index``: by dim leaders, links of their graph, slack, shards of the cells."""

    def route(batches):
        graphs = {dim: (Graph(x, links), slack, shards) for dim, (x, links, slack, shards) in index.items()}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                if dim in graphs:
                    graph, slack, shards = graphs[dim]
                    cells = audited(graph, _unit(_vectors(rows.column("v"), dim)), 0.0, slack=slack)
                    homes, goes = [c[0] for c in cells], [np.unique(shards[c]) for c in cells]
                    where = shards[homes]
                else:
                    cells = goes = [np.zeros(1, np.int64)] * rows.num_rows
                    homes = where = np.zeros(rows.num_rows, np.int64)
                lists = lambda of: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in of])], pa.int32()), pa.array(np.concatenate(of), pa.int32()))
                own = [rows.column(c) for c in ("id", "dim", "weight", "v")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(homes, pa.int32()), pa.array(where, pa.int32()), lists(cells), lists(goes)], ["id", "dim", "weight", "v", "home", "shard", "cells", "goes"])

    return route


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b make a spanning forest of all."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root, kept, left = ends[: len(a)], ends[len(a) :], np.arange(len(names)), [], np.arange(len(a))
    while True:
        u, v = root[a[left]], root[b[left]]
        left, high, low = left[u != v], np.maximum(u, v)[u != v], np.minimum(u, v)[u != v]
        if not len(left):
            return np.concatenate(kept) if kept else left
        pick = np.full(len(names), -1)
        pick[high] = np.arange(len(left))  # one link to a smaller root each: no circle
        hung = np.flatnonzero(pick >= 0)
        kept.append(left[pick[hung]])
        root[hung] = low[pick[hung]]
        while (root[root] != root).any():
            root = root[root]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles, times a power of two each so that no square is out of range."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of list columns, one behind the other."""
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in lists])
    return np.repeat(np.arange(len(lengths)), lengths), np.concatenate([c.flatten().to_numpy() for c in lists]).astype(np.int64)


class Shard:
    """The members of a shard, by their homes."""

    def __init__(self, dim: int, members: list[pa.RecordBatch]):
        read = lambda n: np.concatenate([m.column(n).to_numpy() for m in members])
        home = read("home")
        order = np.argsort(home, kind="stable")
        self.ids, self.weights = read("id")[order], read("weight")[order]
        self.x = np.concatenate([_vectors(m.column("v"), dim) for m in members])[order]
        self.unit = _unit(self.x)
        self.cells, self.starts = np.unique(home[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]
        row, cell = _flat([m.column("cells") for m in members])
        self.width = int(cell.max()) + 1
        self.visits = np.sort(np.argsort(order, kind="stable")[row] * self.width + cell)

    def _visits(self, member: np.ndarray, cell: np.ndarray) -> np.ndarray:
        key = member * self.width + cell
        at = np.minimum(np.searchsorted(self.visits, key), len(self.visits) - 1)
        return (cell < self.width) & (self.visits[at] == key)

    def answer(self, asked: pa.RecordBatch, bound: float) -> pa.RecordBatch:
        """(id, links, null) of visitors and members, and rows (id, null, other) of a spanning forest."""
        qid, weight, home = (asked.column(n).to_numpy() for n in ("id", "weight", "home"))
        qx = _vectors(asked.column("v"), self.x.shape[1])
        unit = _unit(qx)
        row, cell = _flat([asked.column("cells")])
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        here = self.cells[at] == cell
        order = np.argsort(at[here], kind="stable")
        row, at = row[here][order], at[here][order]
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
        own, others, a, b = np.zeros(len(qid), np.int64), np.zeros(len(self.ids), np.int64), [qid[:0]], [self.ids[:0]]
        for first, last in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            start, end = self.starts[at[first]], self.ends[at[first]]
            step = max(1, PART // (4 * int(end - start)))
            for k in range(first, last, step):
                rows = row[k : min(k + step, last)]
                sims = unit[rows] @ self.unit[start:end].T
                hit = np.flatnonzero(sims.ravel() >= bound - 1e-5)
                if not len(hit):
                    continue
                (i, j), s = divmod(hit, sims.shape[1]), sims.ravel()[hit]
                i, j = rows[i], j + start
                sure = (s >= bound + 1e-5) & (qid[i] != self.ids[j])
                near = np.flatnonzero((s < bound + 1e-5) & (qid[i] != self.ids[j]))
                for n in range(0, len(near), CHUNK):
                    some = near[n : n + CHUNK]
                    p, q = _scaled(qx[i[some]]), _scaled(self.x[j[some]])
                    sure[some] = (p * q).sum(1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= bound
                i, j = i[sure], j[sure]
                np.add.at(own, i, self.weights[j])
                alone = home[i] != self.cells[at[first]]
                alone[alone] = ~self._visits(j[alone], home[i[alone]])
                np.add.at(others, j[alone], weight[i[alone]])
                tree = forest(qid[i], self.ids[j])
                a.append(qid[i[tree]])
                b.append(self.ids[j[tree]])
        a, b = np.concatenate(a), np.concatenate(b)
        tree, told = forest(a, b), np.flatnonzero(others)
        ids, links = np.concatenate([qid, self.ids[told]]), np.concatenate([own, others[told]])
        columns = [pa.array(np.concatenate([ids, a[tree]])), pa.concat_arrays([pa.array(links), pa.nulls(len(tree), pa.int64())]), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b[tree])])]
        return pa.RecordBatch.from_arrays(columns, ["id", "links", "other"])


def _search(bound: float):
    """Rows sorted by (dim, shard, sub, salt): the shard's members, then its visitors. One shard and one batch of visitors are in hand."""

    def search(batches):
        now, members, shard = None, [], None
        for b in batches:
            keys = np.stack([b.column(n).to_numpy() for n in ("dim", "shard", "sub", "salt", "visitor")], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                rows = b.slice(start, end - start)
                if (key := tuple(keys[start, :4].tolist())) != now:
                    now, members, shard = key, [], None
                if not keys[start, 4]:
                    members.append(rows)
                elif members or shard:
                    shard, members = shard or Shard(key[0], members), []
                    yield shard.answer(rows, bound)

    return search


def _index(points: DataFrame, bound: float) -> dict:
    """By dim: leaders, links of their graph, slack, shards of the cells. Of a dim that is not in it all vectors are one cell."""
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter("n >= 32").orderBy(F.desc("n"), "dim").limit(DIMS).collect()}
    total, taken = sum(sizes.values()), {}
    for dim, n in sizes.items():
        most = max(1, min(MOST, LEADER_BYTES // (4 * dim)) * n // total)
        taken[dim] = (min(most, max(n // CELL, min(n // 16, CELL // 4))), max(1, min(SAMPLE, most)))
    if not taken:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, min(1.0, 1.1 * sum(taken[dim]) / n))]), F.col("dim"))
    mixed = F.xxhash64("id", F.lit(7))
    sample = points.filter(F.col("dim").isin(list(sizes)) & (F.pmod(mixed, F.lit(1 << 30)) < share * (1 << 30))).select("dim", "v", mixed.alias("h")).toArrow()
    index = {}
    for dim, n in sizes.items():
        some = sample.filter(pa.array(sample["dim"].to_numpy() == dim)).sort_by("h")
        if not some.num_rows:
            continue
        x, (k, others) = _unit(_vectors(some["v"], dim)), taken[dim]
        leaders = thinned(x[:k], bound)
        shards = max(1, min(SHARDS, n // LEAST), -(-n // PER_SHARD), -(-n * 8 * dim // SHARD_BYTES))
        weights = np.bincount(np.concatenate([(x[i : i + CHUNK] @ leaders.T).argmax(1) for i in range(0, len(x), CHUNK)]), minlength=len(leaders))
        rest = x[k : k + others] if len(x) > k + 1 else x
        index[dim] = (leaders, Graph(leaders).links, slack_for(leaders, rest, bound), shards_of(leaders, weights + 1e-3, shards))
    return index


def near_copies(table: DataFrame, id: str = "vec_id", vector: str = "embedding", bound: float = 0.9) -> DataFrame:
    """``table`` with n_links (long), component_id and kept (id = component_id)."""
    return apart(table, lambda d: _near_copies(d, "vec_id", "embedding", bound), {"vec_id": id, "embedding": vector}, ADDED)


def _near_copies(table: DataFrame, id: str, vector: str, bound: float) -> DataFrame:
    spark = table.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "vectors")
    v = F.col(vector) if table.schema[vector].dataType.elementType.typeName() == "float" else F.col(vector).cast("array<double>")
    # NaN and infinities: their product with zero isn't zero.
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (c * 0 == 0)) & F.exists(v, lambda c: c != 0), F.lit(False)) & F.col(id).isNotNull()
    hashed = table.withColumns({"_h1": F.when(sound, F.xxhash64(v)), "_h2": F.when(sound, F.xxhash64(F.lit(1), v))})
    rows = hashed.filter("_h1 is not null").select(F.col(id).cast("long").alias("id"), v.alias("v"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2"))
    points = scratch.table(rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    # Further vectors of an id get a number of their own, above all ids, and a link to it.
    again = points.groupBy("least").agg(F.min("h1").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("least", "first")
    again = scratch.table(again, "again")
    repeated = rows.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("id")
    repeated = scratch.table(repeated, "repeated")
    number = F.when(F.col("first").isNull() | (F.col("first") == F.col("h1")), F.col("least")).otherwise(F.xxhash64("h1", "h2").bitwiseAND(F.lit((1 << 62) - 1)) + (1 << 62))
    points = points.join(F.broadcast(again) if is_small(again) else again, "least", "left").withColumn("id", number).drop("least", "first")
    points = scratch.table(points, "points")
    index = _index(points, bound)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = points.select("id", "dim", "weight", "v").repartition(tasks, "id").mapInArrow(_route(index), f"id long, dim int, weight long, v {points.schema['v'].dataType.simpleString()}, home int, shard int, cells array<int>, goes array<int>")
    routed = scratch.table(routed, "routed")
    # What a shard holds beyond the bounds goes to further ones with the same visitors.
    subs = F.ceil(F.greatest(F.col("n") / PER_SHARD, F.col("n") * 8 * F.col("dim") / SHARD_BYTES)).cast("int")
    large = routed.groupBy("dim", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("subs", subs).filter("subs > 1").select("dim", "shard", "subs")
    large = F.broadcast(scratch.table(large, "large"))
    # The tasks that run at once, twice: they don't all take the same time.
    shards = max([1, *(int(x[3].max()) + 1 for x in index.values())])
    salts = max(1, min(-(-tasks // shards), -(-2 * spark.sparkContext.defaultParallelism // shards)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    subs = F.coalesce("subs", F.lit(1))
    sub = F.pmod(F.xxhash64("id", F.lit(5)), subs).cast("int")
    there = routed.join(large, ["dim", "shard"], "left").select("dim", "shard", sub.alias("sub"), every(F.lit(salts)).alias("salt"), F.lit(0).alias("visitor"), "id", "weight", "v", "home", "cells")
    asked = routed.select("id", "dim", "weight", "v", "home", "cells", F.explode("goes").alias("shard")).join(large, ["dim", "shard"], "left")
    asked = asked.select("dim", "shard", every(subs).alias("sub"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("visitor"), "id", "weight", "v", "home", "cells")
    slot = F.pmod((F.col("shard") + F.xxhash64("sub", "dim") % F.lit(tasks)) * salts + F.col("salt"), F.lit(tasks)).cast("int")
    dealt = there.unionByName(asked).repartitionById(tasks, slot).sortWithinPartitions("dim", "shard", "sub", "salt", "visitor")
    answers = scratch.table(dealt.mapInArrow(_search(bound), "id long, links long, other long"), "answers")
    scratch.drop("routed")
    joined = answers.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))
    if repeated.head(1):
        of = points.select("h1", "h2", F.col("id").alias("v"))
        joined = joined.union(rows.join(repeated, "id", "left_semi").select("id", "h1", "h2").distinct().join(of, ["h1", "h2"]).select(F.col("id").alias("u"), "v"))
    comps = components(joined)
    links = answers.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    known = points.select("h1", "h2", "id", "weight").join(links, "id").join(comps, "id", "left")
    known = known.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("links") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    known = scratch.table(known, "known")
    out = hashed.join(F.broadcast(known) if is_small(known) else known, ["_h1", "_h2"], "left")
    component = F.coalesce("c", F.col(id).cast("long"))
    return out.select(*table.columns, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id).cast("long") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all vectors, cosine 0.9."""
    return near_copies(load(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", *ADDED)
