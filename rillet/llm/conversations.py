"""Conversation structure repair by Dijkstra's search on the edit lattice.

A node is (rows read, grammar state); an edit leads on and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant
turn 3, and 3 more for a truncated row that stays. Blank and repeated rows can only be deleted. Role initials have to come out as ``(s?(ua)+)?``.
The queue is ordered by (cost, audit), audit being the edits' initials so far, and the search ends with the first accepting node behind the last
row that comes off it. Paths to one node that cost the same never have audits of which one begins the other (what follows could only be
inserts, which cost), so the order of two audits isn't changed by what follows.

1. Equal rows of a conversation are one row with a number of copies, summed map-side. The first turn of each text that a conversation has at several
   turns is joined back; most conversations have none.
2. Conversations are dealt out by id and sorted; a task reads them as a stream. Of a row that was read it holds one byte, for the search, and the
   text, until a conversation has HELD bytes of it: longer ones are searched by their bytes alone and their texts pass by once more, behind
   the audit. The search goes through a conversation in blocks of BLOCK rows: behind a block four nodes at most are live, and their
   audits are known by rank and by chains of pieces that they share. What a task holds is one conversation's bytes, about one a row.

A digest of a whole conversation is a chain over its rows: one conversation is read by one task, however long, as a stream.

Defined cases: a null role or text is one space, a null id is a conversation of its own, null turns come first and are no gap; rows of one turn
stand by role, then text; an empty role has no initial and has to be given one; without rows all numbers are zero, the audit is empty; rows that
repeat are duplicates; columns besides these four are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, is_small, load

HELD, BLOCK = 8 << 20, 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, behind the system turn, behind a user's, behind an assistant's. What may follow, and the state behind it.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _ways(token: str, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows read, state) of each edit. Tokens are a row's initial (o: another), a capital if truncated, or X."""
    spoken = 3 if state == 2 else 2
    yield INSERT, "I", 0, spoken
    if token:
        yield DELETE, "D", 1, state
        if token != "X":
            more = TRUNCATED * token.isupper()
            yield REROLE + more, "R", 1, spoken
            if token.lower() in FOLLOWS[state]:
                yield KEEP + more, "K", 1, FOLLOWS[state][token.lower()]


_WAYS = {(t, s): tuple(_ways(t, s)) for t in ("", *"suaoSUAOX") for s in range(4)}


def _through(tokens: str, live: list[tuple[int, int, str, int]], last: bool) -> list[tuple[int, int, str, int]]:
    """From the live nodes before a block, as (cost, rank, audit, state), to those behind it; of the last block the cheapest accepting one."""
    queue, done, ends = [(cost, rank, audit, 0, state) for cost, rank, audit, state in live], set(), []
    heapq.heapify(queue)
    while queue:
        cost, rank, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(tokens):
            if last and state in ENDS:
                return [(cost, rank, audit, state)]
            ends.append((cost, rank, audit, state))
        for more, edit, read, then in _WAYS[tokens[i : i + 1], state]:
            if (i + read, then) not in done:
                heapq.heappush(queue, (cost + more, rank, audit + edit, i + read, then))
    return ends


def cheapest(tokens: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, of those the least audit."""
    live, chains, at = [(0, 0, "", 0)], [None], 0
    while at + block < len(tokens):
        ends = sorted(_through(tokens[at : at + block], live, False), key=lambda e: e[1:3])
        # Audits of which one begins the other share a rank and keep what they have more; the others are told apart by rank alone.
        live, grown, root = [], [], None
        for cost, rank, audit, state in ends:
            if root is None or root[0] != rank or not audit.startswith(root[1]):
                root = (rank, audit)
                grown.append((chains[rank], audit))
            live.append((cost, len(grown) - 1, audit[len(root[1]) :], state))
        chains, at = grown, at + block
    cost, rank, audit, _ = _through(tokens[at:], live, True)[0]
    parts, chain = [audit], chains[rank]
    while chain:
        chain, part = chain
        parts.append(part)
    return cost, "".join(reversed(parts))


class Replay:
    """The turns that an audit makes of the rows, as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _spoken(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _turn(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = FOLLOWS[self.state][role[0]]
        return edit, role, text

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", self._spoken(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, role if edit == "K" else self._spoken(), text)


class Digest:
    """SHA-256 of ``role:text`` rows joined by line breaks."""

    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def add(self, turns) -> None:
        for _, role, text in turns:
            self.sum.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True


class Read:
    """One conversation while its rows go by: what is counted, the search's tokens, and the texts up to ``held`` bytes of them."""

    def __init__(self, id, held: int):
        self.id, self.limit, self.size, self.rows, self.tokens = id, held, 0, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn, role: str, text: str, copies: int, fault: str) -> None:
        if not copies:
            return
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.illegal += (self.before is not None and f"{self.before}{initial}" not in ("su", "ua", "au")) + copies - 1
        self.before = initial
        if fault == "blank":
            self.blank += copies
        else:
            again = copies if fault == "duplicate" else copies - 1
            self.duplicate += again
            self.truncated += fault == "truncated"
        first = fault in ("", "truncated")
        self.tokens.append((initial.upper() if fault else initial) * first + "X" * (copies - first))
        self.size += len(role) + len(text)
        if self.size <= self.limit:
            self.rows.append((role, text, copies))
        else:
            self.rows = None

    def told(self) -> tuple[list, str]:
        cost, audit = cheapest("".join(self.tokens))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost], audit


def _turns(replay: Replay, rows) -> Iterator[tuple[str, str, str]]:
    for role, text, copies in rows:
        for _ in range(copies):
            yield from replay.row(role, text)
    yield from replay.inserts()


def _stream(schema: pa.Schema, held: int, turns: bool):
    """Sorted rows to one row a conversation or, with ``turns``, to the repaired turns. Conversations beyond ``held`` are told without a digest
    (as a turn: with the audit as text and no edit); with the audit in front they are replayed."""
    some = 2048

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def whole(read: Read):
        counts, audit = read.told()
        if read.rows is None:
            yield (read.id, None, None, None, audit) if turns else (read.id, *counts, audit, None)
        elif turns:
            for place, (edit, role, text) in enumerate(_turns(Replay(audit), read.rows)):
                yield read.id, place, edit, role, text
        else:
            digest = Digest()
            digest.add(_turns(Replay(audit), read.rows))
            yield read.id, *counts, audit, digest.sum.hexdigest()

    def rows_of(batches):
        now, read, replay, digest, place = object(), None, None, None, 0

        def close():
            if read is not None:
                yield from whole(read)
            elif replay is not None:
                yield from replayed(replay.inserts())
                if not turns:
                    yield now, *[None] * len(COUNTS), None, digest.sum.hexdigest()

        def replayed(made):
            nonlocal place
            if turns:
                for edit, role, text in made:
                    yield now, place, edit, role, text
                    place += 1
            else:
                digest.add(made)

        for b in batches:
            for id, turn, role, text, copies, fault, audit in zip(*[c.to_pylist() for c in b.columns]):
                if id != now:
                    yield from close()
                    now, place = id, 0
                    replay, digest, read = (Replay(audit), Digest(), None) if audit is not None else (None, None, Read(id, held))
                if read is not None:
                    read.add(turn, role, text, copies, fault)
                elif audit is None:
                    for _ in range(copies):
                        yield from replayed(replay.row(role, text))
        yield from close()

    def stream(batches):
        rows, size = [], 0
        for row in rows_of(batches):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= some or size > HELD:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    return stream


def judged(table: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(id, turn, role, text, copies, fault): equal rows as one, each with its first fault: blank, duplicate (all its copies), truncated or none.
    ``copies``: a column that says how often a row counts; rows that count zero times still name their conversation."""
    scratch = Scratch(table.sparkSession, "conversations")
    plain = table.select(F.col(id).alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    rows = scratch.table(plain.groupBy("id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "rows")
    digest = F.sha2("text", 256)
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.filter("copies > 0").groupBy(F.col("id").alias("of"), F.col("role").alias("as"), digest.alias("digest")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    again = scratch.table(again, "again")
    again = F.broadcast(again) if is_small(again) else again
    bare = F.rtrim("text", F.lit(BLANKS))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as")) & (digest == F.col("digest"))
    fault = F.when(bare == "", "blank").when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.join(again, same, "left").select("id", "turn", "role", "text", "copies", fault.alias("fault"))


def _repaired(rows: DataFrame, held: int, turns: bool) -> DataFrame:
    id = rows.schema["id"]
    names = [("place", LongType()), ("edit", StringType()), ("role", StringType()), ("text", StringType())] if turns else [*((c, LongType()) for c in COUNTS), ("audit", StringType()), ("repaired_sha256", StringType())]
    schema = StructType([StructField("id", id.dataType), *(StructField(n, t) for n, t in names)])
    from pyspark.sql.pandas.types import to_arrow_schema

    stream = _stream(to_arrow_schema(schema), held, turns)
    scratch = Scratch(rows.sparkSession, "repair")
    rows = scratch.table(rows, "rows").withColumn("audit", F.lit(None).cast("string"))
    read = lambda df: df.repartition("id").sortWithinPartitions("id", F.desc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "text").mapInArrow(stream, schema)
    first = scratch.table(read(rows), "first")
    long = scratch.table(first.filter("edit is null" if turns else "repaired_sha256 is null").select(F.col("id").alias("of"), (F.col("text") if turns else F.col("audit")).alias("found")), "long")
    if not long.head(1):
        return first
    keys = long.select("of")
    texts = rows.join(F.broadcast(keys) if is_small(keys) else keys, F.col("id").eqNullSafe(F.col("of")), "left_semi")
    heads = long.select(F.col("of").alias("id"), F.col("found").alias("audit"))
    again = read(texts.unionByName(heads, allowMissingColumns=True))
    if turns:
        return first.filter("edit is not null").unionByName(again)
    sums = again.select(F.col("id").alias("of"), F.col("repaired_sha256").alias("late"))
    joined = first.join(sums, F.col("id").eqNullSafe(F.col("of")), "left")
    return joined.select("id", *COUNTS, "audit", F.coalesce("repaired_sha256", "late").alias("repaired_sha256"))


def repaired(table: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, held: int = HELD) -> DataFrame:
    """(id, place, edit, role, text): the turns of each repaired conversation in order, with the edit that each comes from."""
    return _repaired(judged(table, id, turn, role, text, copies), held, True).withColumnRenamed("id", id)


def summary(table: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, held: int = HELD) -> DataFrame:
    """One row a conversation: what is wrong with it, the cheapest repair's cost and audit, and the digest of what it makes."""
    return _repaired(judged(table, id, turn, role, text, copies), held, False).withColumnRenamed("id", id)


def damaged(table: DataFrame) -> DataFrame:
    """``conversations`` with a fixed share of rows dropped (copies 0), emptied, left without full stops, doubled (copies 2) or given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = F.when(kind == 4, "user").otherwise(told("role")), F.when(kind == 1, "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    gone = kind == 0
    return table.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all conversations, damaged as the contract says, judged and repaired."""
    return summary(damaged(load(spark, sf_dir, "conversations")), copies="copies")
