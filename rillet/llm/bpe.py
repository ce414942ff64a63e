"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is one token that can end its encoding: the token t, ending there, whose
predecessor (the last token of the prefix before t) stays apart from t under the merges. Storing that last token for each
prefix gives the encoding by walking back, makes appending exact (old prefixes never change) and lets an edit re-encode
from the first changed byte alone. A piece that is itself a token is that token, as rank tables define it.

Whether two tokens stay apart is read off the pairs that tokens are merged from: undoing the later of the two merges next to
their border again and again goes through all pairs that ever meet there, and none of these may merge before it is gone.

Text is first cut by the tokenizer's pattern. Pieces that a worker doesn't know are encoded together, their prefixes of one length
after the other in numpy, and the latest pieces are remembered in bounded number.
Everything is per row, so the plan is one scan with Arrow batches and no shuffle. Defined cases: null counts as empty
text; an empty text has no tokens; text of any length is encoded whole, its work linear in its bytes.
"""

from __future__ import annotations

import base64
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, bound_batches, give_back, held, load

#: Pieces longer than LONG bytes are encoded alone and not remembered. Pieces are looked up for so many characters of text at a time.
LONG, TOGETHER = 64, 1 << 19
#: Up to twice so many pieces, and so many pairs of tokens, are remembered by a worker.
PIECES, PAIRS = 80_000, 300_000


class Table:
    """Numbers by number (non-negative), in arrays: open addressing, looked up for many keys at a time."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their values, -1 where there is none."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            same = there == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        self.n += len(keys)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys  # of two keys that want a free place one gets it
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = bytes_by_id(ranks)
        #: The two tokens that a token is merged from; None for single bytes and for tokens that no merge makes.
        self.merged: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        for token, b in enumerate(self.bytes_of):
            for i in range(1, len(b or b"")):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None and max(left, right) < token and self.made(left) and self.made(right) and self.apart(left, right, token):
                    self.merged[token] = left, right
                    break
        self.length = np.array([len(b or b"") for b in self.bytes_of], np.int32)
        #: The longest token that a token ends with, itself left out (-1: none).
        self.shorter = np.array([next((t for i in range(1, len(b or b"")) if (t := ranks.get(b[i:])) is not None), -1) for b in self.bytes_of], np.int32)
        # Tokens read backwards: nodes by (node, byte), and the longest token on the way to each. Lengths ascend, so a node's parent is done.
        step: dict[int, int] = {}
        ends = [-1]
        for b in sorted(ranks, key=len):
            node = 0
            for x in reversed(b):
                if (deeper := step.get(node << 8 | x)) is None:
                    deeper = step[node << 8 | x] = len(ends)
                    ends.append(ends[node])
                node = deeper
            ends[node] = ranks[b]
        self.ends, self.step = np.array(ends, np.int32), Table(max(4, (2 * len(step)).bit_length()))
        self.step.add(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))
        self.stay = Table((3 * PAIRS).bit_length())

    def made(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token; one that no merge makes can't be a part of an encoding."""
        return self.merged[token] is not None or len(self.bytes_of[token]) == 1

    def apart(self, left: int, right: int, most: int) -> bool:
        """Whether the two tokens, side by side, stay so under the merges of ranks below ``most``."""
        name, merged, rank = self.bytes_of, self.merged, self.ranks.get
        while True:
            # ``most``: from this rank on one of the two is part of another token. Of merges of one rank the left one comes first.
            if rank(name[left] + name[right], most) < most:
                return False
            a, b = merged[left], merged[right]
            if a and (left > right or not b):
                left, most = a[1], min(most, left)
            elif b:
                right, most = b[0], min(most, right + 1)
            else:
                return True

    def stays(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: nothing) in an encoding."""
        return self.made(right) and (left < 0 or self.apart(left, right, len(self.bytes_of)))

    def all_stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stays`` of many pairs, remembered."""
        pairs = (left.astype(np.int64) + 1) << 32 | right
        told = self.stay.find(pairs)
        if (told < 0).any():
            new = np.unique(pairs[told < 0])
            if self.stay.n + len(new) > PAIRS:
                self.stay = Table(self.stay.bits if len(new) < PAIRS else (3 * len(new)).bit_length())
            self.stay.add(new, np.array([self.stays((x >> 32) - 1, x & 0xFFFFFFFF) for x in new.tolist()], np.int32))
            told[told < 0] = self.stay.find(pairs[told < 0])
            if (told < 0).any():  # the table was emptied
                return self.all_stay(left, right)
        return told > 0

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces of LONG bytes at most, prefixes of one length at a time."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        size = np.array([len(pieces[i]) for i in order])
        there = np.arange(size[0]) < size[:, None]
        text = np.zeros(there.shape, np.int64)
        text[there] = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
        text = np.ascontiguousarray(text.T)
        last = np.full((size[0] + 1, len(order)), -1, np.int32)
        for end in range(1, size[0] + 1):
            rows = np.arange(there[:, end - 1].sum())
            token, node, walking = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int64), rows
            for at in range(end - 1, -1, -1):
                node = self.step.find(node << 8 | text[at, walking])
                walking, node = walking[node >= 0], node[node >= 0].astype(np.int64)
                if not len(walking):
                    break
                token[walking] = self.ends[node]
            while len(rows):
                if (token < 0).any():
                    raise ValueError(f"no token ends a prefix of {end} bytes")
                fits = self.all_stay(last[end - self.length[token], rows], token)
                last[end, rows[fits]] = token[fits]
                rows, token = rows[~fits], self.shorter[token[~fits]]
        back, rows, end = [], np.arange(len(order)), size.copy()
        while len(rows):
            back.append(np.full(len(order), -1, np.int32))
            back[-1][rows] = token = last[end[rows], rows]
            end[rows] -= self.length[token]
            rows = rows[end[rows] > 0]
        tokens = np.stack(back[::-1], 1)
        bounds, packed = np.cumsum([0, *(4 * (tokens >= 0).sum(1))]).tolist(), tokens[tokens >= 0].tobytes()
        out = [b""] * len(order)
        for k, i in enumerate(order):
            out[i] = packed[bounds[k] : bounds[k + 1]]
        return out

    def longest(self, piece: bytes, start: int, end: int) -> list[int]:
        """The longest token that ends at each byte from ``start`` to ``end`` (-1: none)."""
        text = np.frombuffer(piece, np.uint8)
        token, node, walking, at = np.full(end - start + 1, -1, np.int32), np.zeros(end - start + 1, np.int64), np.arange(end - start + 1), np.arange(start - 1, end)
        while len(walking):
            node = self.step.find(node << 8 | text[at])
            deeper = node >= 0
            walking, at, node = walking[deeper], at[deeper] - 1, node[deeper].astype(np.int64)
            token[walking] = self.ends[node]
            walking, at, node = walking[at >= 0], at[at >= 0], node[at >= 0]
        return token.tolist()

    def extend(self, piece: bytes, known: list[int], start: int = 1) -> list[int]:
        """The same for one piece, however long: known[i] ends its first i bytes. Appending leaves what is known as it is."""
        seen: dict[tuple[int, int], bool] = {}
        for first in range(start, len(piece) + 1, TOGETHER):
            for end, token in enumerate(self.longest(piece, first, min(len(piece), first + TOGETHER - 1)), first):
                while token >= 0:
                    pair = known[end - len(self.bytes_of[token])], token
                    if (fits := seen.get(pair)) is None:
                        if len(seen) > PAIRS:
                            seen.clear()
                        fits = seen[pair] = self.stays(*pair)
                    if fits:
                        break
                    token = int(self.shorter[token])
                else:
                    raise ValueError(f"no token ends at byte {end} of a piece of {len(piece)} bytes")
                known.append(token)
        return known

    def edited(self, old: bytes, known: list[int], new: bytes) -> list[int]:
        """The prefix table of ``new``, from that of ``old``: what stands before the first changed byte is kept."""
        same = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
        return self.extend(new, known[: same + 1], same + 1)

    def walk(self, piece: bytes, known: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end:
            out.append(token := known[end])
            end -= len(self.bytes_of[token])
        return out[::-1]

    def piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG:
            return self.walk(piece, self.extend(piece, [-1]))
        return np.frombuffer(self.pieces([piece])[0], np.int32).tolist() if piece else []


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bytes_by_id(ranks: dict[bytes, int]) -> list[bytes | None]:
    names: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        names[i] = b
    return names


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Codec:
    """A vocabulary file and a pattern; one a worker process. One that only decodes holds the tokens' bytes alone."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        #: Packed ids by piece: those met lately, and those that were met lately when the latter began.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def bytes_of(self) -> list[bytes | None]:
        return self.bpe.bytes_of if "bpe" in self.__dict__ else bytes_by_id(read_ranks(self.path))

    @cached_property
    def bpe(self) -> PrefixBPE:
        made = PrefixBPE(read_ranks(self.path))
        give_back()
        return made

    @cached_property
    def cut(self):
        import regex

        return regex.compile(self.pattern)

    def look_up(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are cut into pieces."""
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        new = set().union(*texts).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        new -= again
        ranks, long, short = self.bpe.ranks, {}, {}
        for p in new:
            b = p.encode()
            if len(b) > LONG:
                long[p] = _pack(self.bpe.piece(b))
            elif (whole := ranks.get(b)) is not None:
                self.known[p] = _pack([whole])
            else:
                short[p] = b
        if short:
            self.known.update(zip(short, self.bpe.pieces(list(short.values()))))
        self.known.update(long)
        packed = [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]
        for p in long:
            del self.known[p]
        return packed

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, four bytes each; what is in hand at once is TOGETHER characters of text, however long a text is."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for t in texts:
            if len(t) > TOGETHER:
                out += self.look_up(group)
                group, size, cuts = [], 0, self.cut.finditer(t)
                runs = iter(lambda: [m[0] for m in islice(cuts, TOGETHER // 8)], [])
                out.append(b"".join(self.look_up([run])[0] for run in runs))
                continue
            group.append(self.cut.findall(t))
            if (size := size + len(t)) > TOGETHER:
                out += self.look_up(group)
                group, size = [], 0
        return out + self.look_up(group)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack([text])[0], np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encoded(self, texts: pa.Array) -> pa.Array:
        packed = self.pack([t or "" for t in texts.to_pylist()])
        at = np.cumsum([0, *map(len, packed)]) // 4
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def decoded(self, lists: pa.Array) -> pa.Array:
        at, values = lists.offsets.to_pylist(), lists.values.to_numpy()
        return pa.array((self.decode(values[a:b].tolist()) for a, b in zip(at, at[1:])), pa.binary())


def codec(path: str, pattern: str) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the multilingual public vocabulary; looked up on each machine, never shipped."""
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def encode(text: Column, vocabulary=public_vocabulary) -> Column:
    """array<int>: the token ids of a text column. ``vocabulary`` is called on the worker, as files lie there."""
    return F.arrow_udf(lambda texts: codec(*vocabulary()).encoded(texts), T.ArrayType(T.IntegerType(), False))(text)


def decode(ids: Column, vocabulary=public_vocabulary) -> Column:
    """binary: the bytes of an array of token ids (null: none)."""
    return F.arrow_udf(lambda lists: codec(*vocabulary()).decoded(lists), T.BinaryType())(ids)


def coded(text: Column, vocabulary=public_vocabulary) -> Column:
    """struct<ids, decoded>: both ways in one worker, so that a task holds one vocabulary."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def both(texts: pa.Array) -> pa.Array:
        own = codec(*vocabulary())
        give_back()  # what the last batch took
        ids = own.encoded(texts)
        return pa.StructArray.from_arrays([ids, own.decoded(ids)], fields=[pa.field("ids", ids.type), pa.field("decoded", pa.binary())])

    return F.arrow_udf(both, kind)(text)


def tokenize(docs: DataFrame, text: str = "text", vocabulary=public_vocabulary) -> DataFrame:
    """``docs`` with ids (array<int>), n_tokens (long) and decoded (binary); columns of those names give way."""
    bound_batches(docs.sparkSession)
    add = lambda d: d.withColumn("coded", coded(F.col("text"), vocabulary)).select("*", "coded.ids", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.decoded")
    return apart(docs, add, {"text": text}, ("ids", "n_tokens", "decoded"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``tokenize`` gives."""
    return tokens.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every whole text of documents."""
    return digests(tokenize(load(spark, sf_dir, "documents").select("doc_id", "text")))
