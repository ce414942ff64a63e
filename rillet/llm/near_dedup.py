"""MinHash near-dedup with odd sketches.

Each document's set of word shingles (64-bit hashes of the word sequences) is min-hashed K times. Bands of the samples make
candidate buckets; folding the samples into a parity bitmap (an odd sketch) leaves 128 bytes a document whose XOR population
count estimates high similarities, so most false candidates fall to a bit count inside the JVM. What remains is confirmed on
the full sets. The steps:

1. Documents with equal sets are one vertex from the start: copies are never compared.
2. In each bucket every member is compared with the bucket's smallest vertex only (a star), linear in the bucket.
3. Confirmed links give components. Buckets whose members all share a component are done: any further link in them would
   change nothing.
4. In the other buckets the members outside the bucket's largest component are compared with all of its members, in blocks of bounded size
   that are dealt out by (bucket, block, block), by sketch and then on full sets, each pair in one bucket only; a task returns the links that
   join components. So a stranger among a million copies costs a million comparisons and no more, no group is gathered in one task, no list of
   a group's pairs is made, and no partner is capped: all links between bucket mates count.

A pair of the threshold's similarity shares no bucket with a probability under MISS, and fails the sketch bound (4.5 standard
deviations) with less.

Defined cases: null, empty and white-space texts have no shingles and link with nothing; texts with fewer words than a shingle
have their whole sequence as one; a row with a null id takes no part: its component is null and it is kept; rows that repeat id
and text are one vertex and keep their rows; an id that has several texts is linked by each of them, and kept (id = component_id) is told of
the id; columns that clash with the added ones give way; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, held, is_small, load
from .components import components

#: MinHash samples, bits of an odd sketch, and the probability with which a pair at the threshold may share no bucket.
K, BITS, MISS = 256, 1024, 1e-4
#: Members of a block in step 4, members compared with one copy of a bucket's smallest vertex, and words whose hashes a worker remembers.
BLOCK, STAR, WORDS = 1024, 1024, 150_000
#: Shingles of a block on average at most: what bounds its memory where texts are long.
BLOCK_SHINGLES = 1_000_000
ADDED = ("n_shingles", "component_id", "kept")


def band_rows(threshold: float, k: int = K, miss: float = MISS) -> int:
    """Samples of a band: as many as keep the probability of missing a pair at the threshold under ``miss``."""
    return max(r for r in range(1, 17) if (1 - threshold**r) ** (k // r) <= miss or r == 1)


def odd_limit(threshold: float, k: int = K, bits: int = BITS, sigmas: float = 4.5) -> int:
    """Differing bits up to which a pair may have the threshold's similarity."""
    flips = 2 * k * (1 - threshold)
    p = (1 - math.exp(-2 * flips / bits)) / 2
    slope = math.exp(-2 * flips / bits)
    sd = math.sqrt(bits * p * (1 - p) + (2 * slope) ** 2 * k * threshold * (1 - threshold))
    return math.floor(bits * p + sigmas * sd)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _words() -> _Words:
    return held("words", _Words)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (a published 64-bit finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The text's set of shingle hashes, ascending: A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for i in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


@lru_cache(4)
def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k].astype(np.uint32), x[k:].astype(np.uint32) | np.uint32(1)


def minhash(sets: np.ndarray, k: int = K) -> np.ndarray:
    """k samples (uint32) of a set of hashes, in blocks so that memory doesn't grow with the text."""
    low, high = (sets & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    xor, times = _seeds(k)
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sets), 256):
        x = (low[at : at + 256, None] ^ xor) * times
        x = (x ^ (x >> np.uint32(15))) + high[at : at + 256, None] * times
        np.minimum(best, x.min(0), out=best)
    return best


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of (position, sample) pairs, as int64 words."""
    k = len(samples)
    at = _mix(samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _sketcher(size: int, rows: int):
    bands = K // rows

    def sketch(batches):
        for b in batches:
            ids, texts, prints = b.column(0), b.column(1), b.column(2)
            out = []
            for t in texts:
                s = shingles(t.as_py(), size)
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                m = minhash(s)
                keys = m[: bands * rows].reshape(bands, rows).astype(np.uint64)
                key = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + keys[:, i])
                whole = (int(np.bitwise_xor.reduce(_mix(s))), int(np.add.reduce(_mix(s ^ np.uint64(0x5BD1E995)))))
                out.append((len(s), *np.array(whole, np.uint64).view(np.int64).tolist(), key.view(np.int64), odd_sketch(m)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [ids, prints, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))],
                ["id", "print", "n", "s1", "s2", "bands", "odd"],
            )

    return sketch


def _confirmer(size: int, percent: int):
    """Sorted (hub, salt, id, text) rows, the hub's own first -> confirmed links. Holds one hub's set at a time."""

    def confirm(batches):
        at, own = None, None
        for b in batches:
            u, v = [], []
            for hub, salt, id, text in zip(*(b.column(n) for n in ("hub", "salt", "id", "text"))):
                hub, salt, id = hub.as_py(), salt.as_py(), id.as_py()
                s = shingles(text.as_py(), size)
                if hub == id:
                    at, own = (hub, salt), s
                elif at == (hub, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        u.append(id)
                        v.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return confirm


def _confirm(docs: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, size: int, percent: int) -> DataFrame:
    """``pairs`` (id, hub), a written table, that have the similarity on full sets. Texts move once for each pair."""
    hubs = _hubs(pairs)
    own = _copies(hubs).select(F.col("hub").alias("of"), "hub", "salt")
    rest = _salted(pairs, hubs).select(F.col("id").alias("of"), "hub", "salt")
    wanted = scratch.table(own.union(rest), f"{name}-wanted")
    texts = docs.join(F.broadcast(wanted) if is_small(wanted) else wanted, F.col("id") == F.col("of")).select("hub", "salt", "id", "text")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = texts.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return scratch.table(dealt.mapInArrow(_confirmer(size, percent), "u long, v long"), name)


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(BITS // 64)), F.lit(0))


def _salted(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """``pairs`` with the salt of each row: a hub's partners are dealt out to as many copies of it as STAR demands."""
    return pairs.join(hubs, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).drop("salts")


def _hubs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).alias("salts"))


def _copies(hubs: DataFrame) -> DataFrame:
    return hubs.select("hub", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))


def _likely(pairs: DataFrame, vertices: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, hub) pairs that sizes and odd sketches leave possible; a check of 128 bytes a side, in the JVM. A hub's sketch is copied to its salts."""
    side = vertices.select("id", "n", "odd")
    hubs = scratch.table(_hubs(pairs), "hub-salts")
    near = F.broadcast(hubs) if is_small(hubs) else hubs
    b = _copies(hubs).join(side.withColumnRenamed("id", "hub"), "hub").alias("b")
    both = _salted(pairs, near).join(side.alias("a"), "id").join(b, ["hub", "salt"])
    fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return both.filter(fits & (_differing("a", "b") <= odd_limit(percent / 100))).select("id", "hub")


def _blocks(size: int, percent: int):
    limit = odd_limit(percent / 100)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Links between a block of a bucket's members outside its largest component and a block of all members, that join components: sketches
        first, then full sets, nearest first. A pair meets in every bucket that both are in; the first of them answers for it."""
        own_key = key[0].as_py()
        id, n, comp, asks, answers, outside = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "n", "comp", "asks", "answers", "outside"))
        bands, odd = np.stack(rows["bands"].to_pylist()), np.stack(rows["odd"].to_pylist()).astype(np.int64).view(np.uint64)
        texts, sets = rows["text"], {}
        root = np.unique(comp, return_inverse=True)[1]

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(texts[k].as_py(), size)
            return sets[k]

        right, u, v = np.flatnonzero(answers), [], []
        for x in np.flatnonzero(asks).tolist():
            near = right[(root[right] != root[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            near = near[~outside[near] | (id[near] > id[x])]  # two that are both outside meet twice
            off = np.bitwise_count(odd[near] ^ odd[x]).sum(1)
            near = near[np.argsort(off, kind="stable")][: (off <= limit).sum()]
            near = near[bands[near, (bands[near] == bands[x]).argmax(1)] == own_key]
            while len(near):
                some, near, own = near[:64], near[64:], full(x)
                flat = np.concatenate([full(k) for k in some.tolist()])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(n[some]) - n[some], dtype=np.int64)
                for y in some[100 * both >= percent * (n[x] + n[some] - both)].tolist():
                    if root[y] != root[x]:
                        u.append(max(id[x], id[y]))
                        v.append(min(id[x], id[y]))
                        root[root == root[y]] = root[x]
                near = near[root[near] != root[x]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def _rest(docs: DataFrame, members: DataFrame, comps: DataFrame, vertices: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(u, v): links between components in buckets that hold several."""
    own = members.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component").join(vertices.select("id", "n"), "id")
    parts = scratch.table(own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")), "bucket-parts")
    several = parts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("all").alias("all")).filter("parts > 1")
    outside = parts.join(several.select("key", "most.comp"), ["key", "comp"], "left_anti").groupBy("key").agg(F.sum("rows").alias("asking"), F.sum("all").alias("asked_for"))
    blocks = lambda rows, n: F.ceil(F.greatest(F.col(rows) / F.lit(BLOCK), F.col(n) / F.lit(BLOCK_SHINGLES))).cast("int")
    several = several.join(outside, "key").select("key", F.col("most.comp").alias("largest"), blocks("rows", "all").alias("js"), blocks("asking", "asked_for").alias("is"))
    several = scratch.table(several, "several")
    left = own.join(F.broadcast(several) if is_small(several) else several, "key").withColumn("outside", F.col("comp") != F.col("largest"))
    at = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    left = scratch.table(left.select("key", "id", "comp", "outside", "is", "js", F.pmod(at, "is").cast("int").alias("i"), F.pmod(at, "js").cast("int").alias("j")), "left")
    ids = scratch.table(left.select("id").distinct(), "left-ids")
    side = F.broadcast(ids) if is_small(ids) else ids
    bodies = docs.join(side, "id", "left_semi").dropDuplicates(["id"]).join(vertices.select("id", "n", "odd", "bands").join(side, "id", "left_semi"), "id")
    # A member answers once in each block of those outside; those outside ask once in each block of members, in their own one by the same row.
    row = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), F.lit(answers).alias("answers"))
    answers = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda x: row(x, F.col("j"), F.col("outside") & (x == F.col("i")), True))
    others = F.filter(F.sequence(F.lit(0), F.col("js") - 1), lambda x: F.col("outside") & (x != F.col("j")))
    to = F.explode(F.concat(answers, F.transform(others, lambda x: row(F.col("i"), x, F.lit(True), False)))).alias("to")
    dealt = left.select("key", "id", "comp", "outside", to).select("key", "id", "comp", "outside", "to.*").join(scratch.table(bodies, "bodies"), "id")
    return scratch.table(dealt.groupBy("key", "i", "j").applyInArrow(_blocks(size, percent), "u long, v long"), "second")


def links(docs: DataFrame, vertices: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(u, v): confirmed links between vertices, enough for the components to be those of all links."""
    flat = vertices.select("id", F.explode("bands").alias("key"))
    hubs = flat.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "hub")
    hubs = scratch.table(hubs, "hubs")
    members = scratch.table(flat.join(F.broadcast(hubs) if is_small(hubs) else hubs, "key"), "members")
    pairs = scratch.table(_likely(members.filter("id <> hub").select("id", "hub").distinct(), vertices, percent, scratch), "pairs")
    first = _confirm(docs, pairs, scratch, "first", size, percent)
    second = _rest(docs, members.select("key", "id"), components(first), vertices, scratch, size, percent)
    scratch.drop("hubs", "members", "left", "left-ids", "bodies")
    return first.union(second)


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with n_shingles, component_id (the smallest id that links reach) and kept (id = component_id); of docs that have but ids and texts the ids
    alone."""
    percent = round(100 * threshold)
    if set(docs.columns) == {id, text}:  # nothing to carry: the texts needn't move
        return _near_copies(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", size, percent).withColumnRenamed("doc_id", id)
    return apart(docs, lambda d: _near_copies(d, "doc_id", "text", size, percent), {"doc_id": id, "text": text}, ADDED)


def _near_copies(docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    kind = "id long, print long, n long, s1 long, s2 long, bands array<long>, odd array<long>"
    sketches = scratch.table(rows.mapInArrow(_sketcher(size, band_rows(percent / 100)), kind), "sketches")
    # Further texts of an id get a number of their own, above all ids, and a link to it.
    again = sketches.filter("id is not null").groupBy("id").agg(F.min("print").alias("first"), F.max("print").alias("last")).filter("first <> last").select("id", "first")
    again = scratch.table(sketches.select("id", "print").join(again, "id").filter("print <> first").distinct().select("id", "print", (F.xxhash64("id", "print").bitwiseAND(F.lit((1 << 62) - 1)) + (1 << 62)).alias("vertex")), "again")
    repeats = bool(again.head(1))
    if repeats:
        side = F.broadcast(again) if is_small(again) else again
        numbered = lambda df: df.join(side, ["id", "print"], "left").withColumns({"own": F.col("id"), "id": F.coalesce("vertex", "id")}).drop("vertex")
        rows, sketches = numbered(rows), numbered(sketches)
    # Equal sets: one vertex, under its smallest id. The copies of a text meet map-side, a row a task and set.
    same = sketches.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min_by(F.struct("id", "bands", "odd"), "id").alias("x"), F.count(F.lit(1)).alias("size"))
    same = scratch.table(same.select("s1", "s2", "n", "size", "x.*"), "same")
    joined = links(rows.filter("id is not null").select("id", "text"), same, scratch, size, percent)
    if repeats:  # from the vertex of each further text to that of the id's first
        of = sketches.filter("n > 0 and id is not null").join(same.select("s1", "s2", "n", F.col("id").alias("of")), ["s1", "s2", "n"]).select("id", "own", "of")
        ids = of.join(again.select(F.col("id").alias("own")).distinct(), "own", "left_semi")
        joined = joined.union(ids.filter("own <> of").select(F.col("own").alias("u"), F.col("of").alias("v")))
    found = components(joined)
    # Only sets that several rows have, or that are linked, have a component other than the row's own id.
    named = same.join(found.withColumnRenamed("component", "c"), "id", "left").filter("size > 1 or c is not null")
    named = scratch.table(named.select("s1", "s2", "n", F.coalesce("c", "id").alias("c")), "named")
    own = sketches.join(F.broadcast(named) if is_small(named) else named, ["s1", "s2", "n"], "left")
    if repeats:
        own = own.withColumns({"c": F.coalesce("c", "own"), "id": F.col("own")})
    own = own.select("id", "print", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
    if set(docs.columns) == {id, text}:
        return own.select(F.col("id").alias(id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    own = own.dropDuplicates(["id", "print"]).select(F.col("id").alias("_id"), F.col("print").alias("_print"), "n_shingles", "component_id")
    kept = F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))
    return docs.join(own, F.col(id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_print")), "left").drop("_id", "_print").withColumn("kept", kept)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies (the one with the smallest id); all columns stay."""
    own = Scratch(docs.sparkSession, "gone").table(near_copies(docs.select(id, text), id, text, size, threshold).filter(~F.col("kept")).select(F.col(id).alias("_id")), "ids")
    gone = (F.broadcast(own) if is_small(own) else own).withColumnRenamed("_id", name := f"gone_{uuid.uuid4().hex}")
    return docs.join(gone, F.col(id) == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents, three-word shingles, similarity 0.85."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies(docs, size=3, threshold=0.85).select("doc_id", *ADDED)
