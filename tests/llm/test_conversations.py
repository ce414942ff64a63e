"""Conversation repair against all edits of small conversations, and against a plain reading of the contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rillet.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(tokens, most_inserts=3):
    """(cost, audit) of the best of all edit sequences with up to ``most_inserts`` inserts."""
    best = None
    n = len(tokens)
    for inserts in range(most_inserts + 1):
        for where in itertools.combinations_with_replacement(range(n + 1), inserts):
            for edits in itertools.product("KRD", repeat=n):
                if any(t == "X" and e != "D" for t, e in zip(tokens, edits)):
                    continue
                audit = "".join("I" * where.count(i) + (edits[i] if i < n else "") for i in range(n + 1))
                cost = 3 * inserts + sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (t.isupper() and e != "D") for t, e in zip(tokens, edits))
                fixed = [x for i in range(n + 1) for x in ["?"] * where.count(i) + ([] if i == n or edits[i] == "D" else ["?" if edits[i] == "R" else tokens[i].lower()])]
                pattern = [a for a in ("", *("s" * s + "ua" * k for s in (0, 1) for k in range(1, n + 3))) if len(a) == len(fixed)]
                if any(all(f == x or f == "?" and x != "s" for f, x in zip(fixed, a)) for a in pattern) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_search_equals_all_edits():
    rng = random.Random(5)
    for tokens in {"", "X", "o", *("".join(rng.choices("suaoSUAOX", k=rng.randint(1, 4))) for _ in range(150))}:
        assert c.cheapest(tokens) == every_repair(tokens), tokens


def test_blocks_change_nothing():
    rng = random.Random(6)
    for alphabet in ("suaoSUAOX", "o", "ua", "uaX", "oO"):
        for _ in range(25):
            tokens = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert {c.cheapest(tokens, b) for b in (1, 2, 3, 7)} == {c.cheapest(tokens, 1000)}, tokens


def test_long_conversations_take_linear_time():
    for part in ("o", "ua", "uXaU"):
        tokens = part * (20_000 // len(part))
        cost, audit = c.cheapest(tokens)
        assert len(audit) - audit.count("I") == len(tokens) and cost >= 0


def plainly(rows):
    """The contract's columns in plain Python; ``rows``: (conv_id, turn, role, text)."""
    out, groups = {}, {}
    for i, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = groups.setdefault(i, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for i, here in groups.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, tokens, faults = set(), [], []
        for _, role, text in here:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            tokens.append("X" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        # Least (cost, audit) of each state after each row, settled by repetition.
        now = {0: (0, "")}
        step = {("", "s"): 0}
        for token in [*tokens, None]:
            changed = True
            while changed:
                changed = False
                for state, (cost, audit) in list(now.items()):
                    to = 3 if state == 2 else 2
                    if (new := (cost + 3, audit + "I")) < now.get(to, (1e9, "")):
                        now[to], changed = new, True
            if token is None:
                break
            then = {}
            for state, (cost, audit) in now.items():
                moves = [(4, "D", state)]
                if token != "X":
                    extra = 3 * token.isupper()
                    moves.append((3 + extra, "R", 3 if state == 2 else 2))
                    low = token.lower()
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}.get((low, state))
                    if to is not None:
                        moves.append((extra, "K", to))
                for more, edit, to in moves:
                    then[to] = min(then.get(to, (1e9, "")), (cost + more, audit + edit))
            now = then
        cost, audit = min(now.get(s, (1e9, "")) for s in (0, 3))
        turns, at, made, place = [t for t, *_ in here if t is not None], 0, [], ""
        for edit in audit:
            spoken = "assistant" if place == "u" else "user"
            if edit == "I":
                made.append(f"{spoken}:")
                place = spoken[0]
                continue
            _, role, text = here[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else spoken
                made.append(f"{role}:{text}")
                place = role[0]
        roles = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in here)
        illegal = sum(p not in ("su", "ua", "au") for p in map("".join, zip(roles, roles[1:])))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[i] = (i, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def held_against(rows, got):
    want = plainly(rows)
    assert {r[0]: tuple(r) for r in got} == want and len(got) == len(want)


def test_query_equals_the_contract(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held_against(rows, c.query(spark, sf_dir).collect())


@pytest.mark.parametrize("held", [c.HELD, 60])
def test_faulty_rows(spark, held):
    rng = random.Random(7)
    texts = [None, "", " \t\r\n", "Yes.", "yes", "No!  \n", "Why? no", "é。", "x" * 500 + ".", "a:b\n."]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "üser"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 9)]), rng.choice(roles[2:] if rng.random() < 0.9 else roles), rng.choice(texts)) for _ in range(400)]
    rows += [(77, t, "user", "again.") for t in range(50)] + [(78, 5, "assistant", "so")] * 90
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = c.summary(c.damaged(table), copies="copies", held=held).collect()
    held_against(rows, got)
    turns = {}
    for r in c.repaired(c.damaged(table), copies="copies", held=held).collect():
        turns.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}", r.edit))
    for r in got:
        made = sorted(turns.get(r.conv_id, []))
        assert hashlib.sha256("\n".join(t for _, t, _ in made).encode()).hexdigest() == r.repaired_sha256
        assert [e for *_, e in made] == [e for e in r.audit if e != "D"] and [p for p, *_ in made] == list(range(len(made)))


def test_other_columns_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", 9, "x", 3, "y", 4), (1, 1, "assistant", "Ho.", 9, "x", 3, "y", 4)], f"{SCHEMA}, id int, fault string, copies int, audit string, first int")
    assert [tuple(r)[1:8] for r in c.summary(table).collect()] == [(0, 0, 0, 0, 0, 0, "KK")]
    assert c.summary(table.limit(0)).count() == c.repaired(table.limit(0)).count() == 0
