"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition takes its texts' 64-bit fingerprints in chunks of bounded size, sorts them, and sends every owner (a range
   of the fingerprint space) its part once per distinct value, as Golomb-Rice codes of the gaps.
2. An owner decodes what it got, finds the values that more than one chunk sent, and answers each chunk with a bitmap.
3. Chunks turn bitmaps, and what they hold twice themselves, into suspects. Only suspects' texts are shuffled, and they are
   grouped by their bytes. Up to SMALL_BYTES of suspects every executor gets them, and a text that no other row shares is never moved. Beyond, every
   executor gets a bitmap of them, SIEVE bits for each and MOST_BITS at most, and a text that no other row shares moves with a probability
   of 1 / SIEVE (more, where the bitmap has reached its most); grouping by bytes settles the rest.

A text that a third of all rows share costs one code a chunk in the exchange and, as grouping sums map-side, one row a task
in the verification. Owners grow in number with the rows, so what one owner holds is bounded.

Defined cases: a null text counts as empty; of equal texts the row with the largest id stays; rows that repeat an id with
the same text count in group_size and are all marked alike (``dedup`` keeps one of them); a null id is smaller than any other;
columns that clash with the added ones give way; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, is_small, load

#: Fingerprints of a chunk at most, and rows for each owner of fingerprints on average.
CHUNK, PER_OWNER = 1 << 18, 1 << 18
#: Bits for each suspect, and bits at most: 128 MB.
SIEVE, MOST_BITS = 32, 1 << 30
HEAVY = 100_000
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def golomb(values: np.ndarray) -> bytes:
    """Ascending distinct uint64 as Golomb-Rice codes of their gaps: quotients in unary, then remainders of a fixed width."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // n) if n else 1
    width = mean.bit_length() - 1
    high = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    if n:
        unary[np.cumsum(high + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(width, dtype=np.uint64)[None]) & np.uint64(1)
    return n.to_bytes(4, "big") + width.to_bytes(1, "big") + len(unary).to_bytes(5, "big") + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8)).tobytes()


def ungolomb(code: bytes) -> np.ndarray:
    n, width, size = int.from_bytes(code[:4], "big"), code[4], int.from_bytes(code[5:10], "big")
    at = 10 + -(-size // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[10:at], np.uint8), count=size))
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(np.frombuffer(code[at:], np.uint8), count=n * width).reshape(n, width).astype(np.uint64)
    low = (low << np.arange(width, dtype=np.uint64)[None]).sum(1, dtype=np.uint64) if width else np.zeros(n, np.uint64)
    return np.cumsum((high << np.uint64(width)) + low, dtype=np.uint64)


def _send(owners: int):
    """Partition -> (chunk, owner, code, twice): ``twice`` has a bit for each value that the chunk itself holds again."""

    def chunks(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += b.num_rows
            if rows >= CHUNK:
                yield np.concatenate(held)
                held, rows = [], 0
        if rows:
            yield np.concatenate(held)

    def send(batches):
        part = TaskContext.get().partitionId()
        for i, prints in enumerate(chunks(batches)):
            values, counts = np.unique(prints, return_counts=True)
            owner = ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(owner, np.arange(owners + 1))
            own = [(o, a, b) for o, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | i] * len(own), pa.int64()),
                    pa.array([o for o, _, _ in own], pa.int32()),
                    pa.array([golomb(values[a:b]) for _, a, b in own], pa.binary()),
                    pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in own], pa.binary()),
                ],
                ["chunk", "owner", "code", "twice"],
            )

    return send


def _answer(sent: pa.Table) -> pa.Table:
    """All that one owner got -> a bitmap for each chunk: which of its values another chunk sent too."""
    values = [ungolomb(c) for c in sent["code"].to_pylist()]
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    again = flat[order][1:] == flat[order][:-1]
    shared = np.zeros(len(flat), bool)
    shared[order[1:]] |= again
    shared[order[:-1]] |= again
    maps = np.split(shared, np.cumsum([len(v) for v in values])[:-1])
    return pa.table({"chunk": sent["chunk"], "owner": sent["owner"], "bitmap": pa.array([np.packbits(m).tobytes() for m in maps], pa.binary())})


def _suspects(batches):
    for b in batches:
        out = []
        for code, twice, bitmap in zip(*(b.column(n).to_pylist() for n in ("code", "twice", "bitmap"))):
            v = ungolomb(code)
            bits = np.frombuffer(twice, np.uint8) | np.frombuffer(bitmap, np.uint8)
            out.append(v[np.unpackbits(bits, count=len(v)).astype(bool)].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], ["fp"])


def suspects(docs: DataFrame, text: Column, scratch: Scratch) -> DataFrame:
    """(fp): the fingerprints that more than one row has, once each."""
    owners = -(-docs.count() // PER_OWNER) or 1
    sent = scratch.table(docs.select(F.xxhash64(text).alias("fp")).mapInArrow(_send(owners), "chunk long, owner int, code binary, twice binary"), "sent")
    maps = sent.select("chunk", "owner", "code").groupBy("owner").applyInArrow(_answer, "chunk long, owner int, bitmap binary")
    return sent.join(maps, ["chunk", "owner"]).select("code", "twice", "bitmap").mapInArrow(_suspects, "fp long").distinct()


def sieved(rows: DataFrame, fp: str, found: DataFrame, bits: int) -> DataFrame:
    """``rows`` with _maybe: false only where the fingerprint is none of ``found``. No row moves."""
    place = lambda c: F.pmod(F.col(c), F.lit(bits)) + 1
    maps = found.groupBy(F.bitmap_bucket_number(place("fp")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("fp"))).alias("_bits"))
    at = F.bitmap_bit_position(place(fp)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(fp)) == F.col("_bucket"), "left")  # bits / 8 bytes: at most MOST_BITS / 8
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))).drop("_bucket", "_bits")


def copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size (long), kept (boolean) and text_sha256 (string) of each row."""
    return apart(docs, lambda d: _copies(d, "doc_id", "text"), {"doc_id": id, "text": text}, ADDED)


def _copies(docs: DataFrame, id: str, text: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "copies")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = scratch.table(suspects(docs.select(text), whole, scratch), "suspects")
    scratch.drop("sent")
    rows = docs.withColumn("_fp", F.xxhash64(whole))
    if small := is_small(found):
        rows = rows.withColumn("_maybe", F.lit(True))
        mine = rows.join(F.broadcast(found), F.col("_fp") == F.col("fp"), "left_semi")
    else:
        rows = sieved(rows, "_fp", found, min(MOST_BITS, max(1 << 15, 1 << (SIEVE * found.count()).bit_length())))
        mine = rows.filter("_maybe")  # grouping their bytes finds those that only seem to be suspects
    # Byte verification: the group's key is the text itself; the digest only names the group from here on.
    groups = mine.groupBy(whole.alias("t")).agg(F.max(id).alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = scratch.table(groups.select(F.sha2("t", 256).alias("_sha"), "_keep", "_size"), "groups")
    rows = rows.withColumn("text_sha256", F.sha2(whole, 256))
    same = F.col("text_sha256") == F.col("_sha")
    if small:  # no more groups than suspects
        out = rows.join(F.broadcast(groups), same, "left")
    else:
        # Groups with more than 1 / HEAVY of the rows are HEAVY at most and go to every executor; their rows are spread over all tasks of the join.
        most = docs.count() // HEAVY
        heavy = F.broadcast(groups.filter(F.col("_size") > most).select(*[F.col(c).alias(f"{c}_h") for c in groups.columns]))
        told = rows.filter("_maybe").join(heavy, F.col("text_sha256") == F.col("_sha_h"), "left")
        told = told.withColumn("_key", F.when(F.col("_sha_h").isNull(), F.col("text_sha256")).otherwise(F.monotonically_increasing_id().cast("string")))
        told = told.join(groups.filter(F.col("_size") <= most), F.col("_key") == F.col("_sha"), "left").withColumns({c: F.coalesce(c, f"{c}_h") for c in groups.columns})
        none = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns]
        out = told.select(*rows.columns, *groups.columns).unionByName(rows.filter(~F.col("_maybe")).select("*", *none))
    alone = F.col("_sha").isNull()
    return (
        out.withColumn("keep_id", F.when(alone, F.col(id)).otherwise(F.col("_keep")))
        .withColumn("group_size", F.coalesce("_size", F.lit(1).cast("long")))
        .withColumn("kept", F.col(id).eqNullSafe(F.col("keep_id")))
        .select(*docs.columns, *ADDED)
    )


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copies: one row of each text, with the columns of ``docs``."""
    return apart(docs, lambda d: _dedup(d, "doc_id", "text"), {"doc_id": id, "text": text}, ())


def _dedup(docs: DataFrame, id: str, text: str) -> DataFrame:
    from pyspark.sql import Window

    kept = _copies(docs, id, text).filter("kept")
    # Only rows that repeat both id and text are still double; they are few, so the rest isn't moved for them.
    again = Scratch(docs.sparkSession, "repeats").table(kept.filter("group_size > 1").groupBy("text_sha256").count().filter("count > 1").select(F.col("text_sha256").alias("_sha")), "sha")
    if not again.head(1):
        return kept.select(*docs.columns)
    mark = F.broadcast(again) if is_small(again) else again
    joined = kept.join(mark, F.col("text_sha256") == F.col("_sha"), "left")
    first = F.row_number().over(Window.partitionBy("_sha").orderBy(F.lit(1)))
    return joined.filter("_sha is null").select(*docs.columns).unionByName(joined.filter("_sha is not null").withColumn("_n", first).filter("_n = 1").select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every row of documents."""
    return copies(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *ADDED)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
