"""Phrase collocation mining by hierarchical pair naming.

1. Tasks cut their texts into blocks of about WORDS words. A block is a sequence of local word numbers, with a bit at the start of each piece, and
   lists of its words with their counts, one list for each owner (a hash of the word) that has any. Nothing is exploded into one row a word.
2. An owner puts the lists of all blocks together. What occurs ``least`` times gets a global id, and each block is told the ids of what it has.
3. A block meets its ids: neighbours that both have one are a pair, a pair of (k-1)-grams that overlap is a k-gram, and the sequence of
   pairs is the next level's. Pairs are listed, counted and named as words were. A pair's parents are its two (k-1)-grams.
4. Following the parents gives the counts of all beginnings and ends of a phrase, so of each cut, one join a level. A phrase lies inside a
   longer one with at least some count just when it is a parent of one: counts never rise with length.

There is no dictionary in any worker: what is held at once is a block or one owner's lists, 1 / spark.sql.shuffle.partitions of all. Lists are sorted and
packed; a word or pair that stands everywhere is one entry a block. Words and pairs are compared by value. The tables of a level are in the shared
folder and go when the next is there.

Defined cases: a null text is empty; a null language is ``und``, together with the language of that name; rows that repeat count as often as
they occur; only A-Z are lower-cased; columns besides text and language are not read; an empty table gives an empty result. A text of more than
WORDS words is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load

LONGEST, LEAST, INSIDE, TOP, WORDS = 5, 100, 100, 2000, 3 << 20
_START = np.uint32(1 << 31)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEVEL = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("owner", pa.int32()), ("lang", pa.string()), ("base", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
_NAMED = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])
_MIX = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts one after the other as bytes, whether each begins a piece, and how many each text has."""
    spans = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[spans[0] : spans[-1]]]
    spans -= spans[0]
    kind = _KIND[data]
    inside = np.r_[False, kind == 0, False]
    edge = np.zeros(len(data) + 1, bool)
    edge[spans] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    ends_bytes = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_bytes), pa.py_buffer(np.ascontiguousarray(data[kind == 0]))])
    piece = np.cumsum((kind == 2) | edge[:-1])[starts]
    return words, np.diff(piece, prepend=-1) != 0, np.diff(np.searchsorted(starts, spans))


def _sequence(numbers: np.ndarray, start: np.ndarray) -> bytes:
    return (numbers.astype(np.uint32) | np.where(start, _START, np.uint32(0))).tobytes()


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, their bytes by significance, compressed."""
    return pa.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: list, n: list[int], kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(pa.decompress(b, width * k, codec="zstd"), np.uint8).reshape(width, k).T for b, k in zip(packed, n)]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.empty(0, kind)


def _rows(schema: pa.Schema, n: int, /, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _level(block: int, seq: bytes, lists: list[dict]) -> pa.Table:
    first = _rows(_LEVEL, 1, block=[block], seq=[seq])
    return pa.concat_tables([first, _rows(_LEVEL, len(lists), block=[block] * len(lists), **{k: [x[k] for x in lists] for k in lists[0]})]) if lists else first


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *new.tolist()], [*new.tolist(), len(keys[0])]))


def _owners(words: pa.Array, salt: np.ndarray, owners: int) -> np.ndarray:
    """A number below ``owners`` for each word and salt, the same everywhere."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    mixed = np.add.reduceat(data * _MIX[place & 255] * (place.astype(np.uint64) + np.uint64(1)), starts) + salt * _MIX[0]
    return ((mixed >> np.uint64(33)) % np.uint64(owners)).astype(np.int32)


def _blocks(owners: int):
    """Texts as blocks: a row with the sequence, and a row for each owner and language with the words' bytes, lengths and counts."""

    def blocks(batches):
        import zlib

        import pandas as pd
        from pyspark import TaskContext

        serial, held, n = 0, [], 0

        def close() -> list[pa.RecordBatch]:
            encoded = pa.chunked_array([w for w, *_ in held]).unify_dictionaries()
            spoken = pa.chunked_array([x for *_, x in held]).unify_dictionaries()
            known, langs = encoded.chunk(0).dictionary, spoken.chunk(0).dictionary.to_pylist()
            at = lambda chunked: np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in chunked.chunks])
            codes, pairs = pd.factorize(at(encoded).astype(np.int64) * len(langs) + np.repeat(at(spoken), np.concatenate([c for _, _, c, _ in held])))
            lang, words = pairs % len(langs), known.take(pa.array(pairs // len(langs)))
            owner = _owners(words, np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)[lang], owners)
            order = np.lexsort((lang, owner))
            rank, counts = np.empty(len(order), np.int64), np.bincount(codes, minlength=len(order))[order]
            rank[order] = np.arange(len(order))
            words, lang, owner, lists = words.take(pa.array(order)), lang[order], owner[order], []
            ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
            for i, j in _runs(owner, lang):
                keys = pa.compress(words.buffers()[2][int(ends[i]) : int(ends[j])], codec="zstd", asbytes=True)
                lists.append({"owner": owner[i], "lang": langs[lang[i]], "base": i, "n": j - i, "keys": keys, "more": _pack(np.diff(ends[i : j + 1])), "counts": _pack(counts[i:j]), "total": counts[i:j].sum()})
            return _level((TaskContext.get().partitionId() << 32) + serial, _sequence(rank[codes], np.concatenate([s for _, s, *_ in held])), lists).to_batches()

        for b in batches:
            words, start, each = words_of(b.column("text"))
            if len(words):
                held.append((words.dictionary_encode(), start, each, b.column("lang").dictionary_encode()))
                n += len(words)
            if n >= WORDS:
                yield from close()
                serial, held, n = serial + 1, [], 0
        if n:
            yield from close()

    return blocks


def _names(least: int):
    """An owner's lists to a row for each name, and for each list the places of what has one, with the ids."""

    def names(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
        import pandas as pd

        n = lists["n"].to_pylist()
        counts = _unpack(lists["counts"].to_pylist(), n, np.int64)
        if lists["lang"][0].is_valid:
            lengths = _unpack(lists["more"].to_pylist(), n, np.int32).astype(np.int64)
            ends = np.r_[0, np.cumsum(lengths)]
            tops = np.cumsum([0, *n])
            data = b"".join(pa.decompress(k, int(ends[j] - ends[i]), codec="zstd", asbytes=True) for k, i, j in zip(lists["keys"].to_pylist(), tops, tops[1:]))
            words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
            langs = lists["lang"].combine_chunks().dictionary_encode()
            both = words.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + np.repeat(langs.indices.to_numpy(), n)
        else:
            left = np.concatenate([np.cumsum(_unpack([b], [k], np.int64)) for b, k in zip(lists["keys"].to_pylist(), n)])
            right = _unpack(lists["more"].to_pylist(), n, np.int64)
            (l, lefts), (r, rights) = pd.factorize(left), pd.factorize(right)
            both = l * len(rights) + r
        codes, found = pd.factorize(both)
        a = np.zeros(len(found), np.int64)
        np.add.at(a, codes, counts)
        often = np.flatnonzero(a >= least)
        ids, named = np.full(len(found), -1, np.int64), found[often]
        ids[often] = (key[0].as_py() << 32) + np.arange(len(often))
        if lists["lang"][0].is_valid:
            width = len(langs.dictionary)
            told = {"lang": langs.dictionary.take(pa.array(named % width)), "word": words.dictionary.take(pa.array(named // width)).cast(pa.binary()).cast(pa.string())}
        else:
            told = {"left": lefts[named // len(rights)], "right": rights[named % len(rights)]}
        out, at = [], 0
        for block, base, k in zip(lists["block"].to_pylist(), lists["base"].to_pylist(), n):
            own = ids[codes[at : at + k]]
            places = np.flatnonzero(own >= 0)
            if len(places):
                out.append((block, _pack((places + base).astype(np.int32)), _pack(own[places]), len(places)))
            at += k
        sent = _rows(_NAMED, len(out), **{c: [x[i] for x in out] for i, c in enumerate(("block", "places", "ids"))}, a=[x[3] for x in out])
        return pa.concat_tables([_rows(_NAMED, len(often), id=ids[often], a=a[often], **told), sent])

    return names


def _pairs(owners: int):
    """A block's next level: the sequence of neighbours that both have a name, and for each owner a list of its pairs with their counts."""

    def pairs_of(sequence: pa.Table, names: pa.Table) -> pa.Table:
        import pandas as pd

        if not (sequence.num_rows and names.num_rows):
            return _rows(_LEVEL, 0)
        seq, n = np.frombuffer(sequence["seq"][0].as_buffer(), np.uint32), names["a"].to_pylist()
        start, numbers = seq >= _START, seq & ~_START
        places, ids = _unpack(names["places"].to_pylist(), n, np.int32), _unpack(names["ids"].to_pylist(), n, np.int64)
        local = np.full(int(numbers.max()) + 1, -1, np.int32)
        local[places] = np.arange(len(ids))
        now = local[numbers]
        both = (now[:-1] >= 0) & (now[1:] >= 0) & ~start[1:]
        at = np.flatnonzero(both)
        codes, found = pd.factorize(now[:-1][both].astype(np.int64) << 32 | now[1:][both])
        left, right = ids[found >> 32], ids[found & 0xFFFFFFFF]
        owner = (((left.astype(np.uint64) * _MIX[1] + right.astype(np.uint64) * _MIX[2]) >> np.uint64(33)) % np.uint64(owners)).astype(np.int32)
        order = np.lexsort((right, left, owner))
        rank, counts = np.empty(len(order), np.int64), np.bincount(codes, minlength=len(order))[order]
        rank[order] = np.arange(len(order))
        left, right, owner = left[order], right[order], owner[order]
        lists = [{"owner": owner[i], "base": i, "n": j - i, "keys": _pack(np.diff(left[i:j], prepend=0)), "more": _pack(right[i:j]), "counts": _pack(counts[i:j])} for i, j in _runs(owner) if j > i]
        return _level(sequence["block"][0].as_py(), _sequence(rank[codes], np.diff(at, prepend=-2) != 1), lists)

    return pairs_of


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of 38 digits: exact for counts up to 3e17."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", above, below).cast("long")


def _best_cut(k: int) -> Column:
    """(score, cut, l, r) of the lowest cut of a phrase of ``k`` words, the first of those that tie."""
    ways = [F.struct(_score(F.col("a"), F.col("n"), F.col("heads")[i], F.col("tails")[k - i - 2]).alias("score"), F.lit(i + 1).alias("cut"), F.col("heads")[i].alias("l"), F.col("tails")[k - i - 2].alias("r")) for i in range(k - 1)]
    return F.array_min(F.array(*ways))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score, within): all phrases of 2 to ``longest`` words that occur ``least`` times, with the lowest cut and the
    largest count of a longer phrase around them (null: none)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    plain = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    from pyspark.sql.pandas.types import from_arrow_schema

    level_type, named_type = from_arrow_schema(_LEVEL), from_arrow_schema(_NAMED)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = scratch.table(plain.mapInArrow(_blocks(owners), level_type), "level1")
    totals = scratch.table(level.filter("lang is not null").groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    phrased: list[DataFrame] = []
    for k in range(1, longest + 1):
        lists = level.filter("seq is null").drop("seq", "total")
        told = scratch.table(lists.groupBy("owner").applyInArrow(_names(least), named_type), f"names{k}")
        names = told.filter("id is not null")
        if k == 1:
            one = names.select("id", "lang", F.array("word").alias("words"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"), "left", "right")
        else:
            head = phrased[-1].select(F.col("id").alias("left"), "lang", "words", "heads")
            tail = phrased[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
            one = names.select("id", "a", "left", "right").join(head, "left").join(tail, "right")
            grown = lambda c: F.concat(c, F.array("a"))
            one = one.select("id", "lang", F.concat("words", F.array("word")).alias("words"), "a", grown("heads").alias("heads"), grown("tails").alias("tails"), "left", "right")
        phrased.append(scratch.table(one, f"phrases{k}"))
        if k < longest:
            back = told.filter("id is null").select(F.col("block").alias("of"), "places", "ids", "a")
            blocks = level.filter("seq is not null").select("block", "seq").groupBy("block").cogroup(back.groupBy("of"))
            level = scratch.table(blocks.applyInArrow(_pairs(owners), level_type), f"level{k + 1}")
            scratch.drop(f"level{k}", f"names{k}")
            spark.sparkContext._jvm.System.gc()  # the shuffle files of finished levels go with what refers to them
    found = None
    for k in range(2, longest + 1):
        one = phrased[k - 1]
        if k < longest:
            around = phrased[k].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("within"))
            one = one.join(around, "id", "left")
        else:
            one = one.withColumn("within", F.lit(None).cast("long"))
        one = one.join(totals, "lang").withColumn("best", _best_cut(k))
        one = one.select("lang", F.array_join("words", " ").alias("phrase"), F.lit(k).alias("k"), "a", "best.l", "best.r", "n", "best.score", "within")
        found = one if found is None else found.union(one)
    return found


def strongest(found: DataFrame, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """Each language's first ``top`` of ``phrases``, without those of which ``inside`` percent stand within one longer phrase."""
    from pyspark.sql import Window

    free = found.filter(F.col("within").isNull() | (F.col("within").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all documents, the first 2,000 phrases of each language."""
    found = phrases(load(spark, sf_dir, "documents").select("text", "lang"))
    return strongest(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \t]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang
), grams AS (SELECT lang, words[i:i + k - 1] AS words FROM places, range(1, {LONGEST + 1}) g(k) WHERE i + k - 1 <= len(words)
), counted AS (SELECT lang, words, count(*) AS a FROM grams GROUP BY lang, words HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT c.lang, c.words, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM counted WHERE len(words) > 1) c JOIN totals t USING (lang)
  JOIN counted l ON l.lang = c.lang AND l.words = c.words[:k] JOIN counted r ON r.lang = c.lang AND r.words = c.words[k + 1:]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, words[i:j] AS words, a FROM (SELECT lang, words, a, unnest(range(1, len(words) + 1)) AS i FROM counted WHERE len(words) > 2), range(2, {LONGEST + 1}) g(j)
  WHERE j > i AND j <= len(words) AND NOT (i = 1 AND j = len(words))
), free AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = b.lang AND p.words = b.words AND 100 * p.a >= {INSIDE} * b.a)
), told AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM free)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM told
QUALIFY rank <= {TOP}
"""
