"""The corpus operators against brute force, exact round trips and held-out labels, and their edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillet.llm import bpe, components, embedding_dedup, exact_dedup, hnsw, html_extract, language_id, line_dedup, mixing, near_dedup, queries, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "ready", "stone", "river", "cloud", "seven", "under", "late", "paper", "green", "house"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


# --- exact dedup


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 1000, 30_000):
        v = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (exact_dedup.ungolomb(exact_dedup.golomb(v)) == v).all()
    for v in ([0], [2**64 - 1], [0, 1, 2, 2**64 - 1]):
        assert exact_dedup.ungolomb(exact_dedup.golomb(np.array(v, np.uint64))).tolist() == v


def test_exact_dedup(spark):
    rows = [(1, "a", "s"), (5, "a", "s"), (3, "a ", "s"), (2, None, "s"), (4, "", "s"), (7, "x" * 200_000, "s"), (8, "x" * 200_000, "s"), (9, "b", "s"), (9, "b", "s"), (None, "c", "s"), (10, "c", "s")]
    df = docs(spark, rows).repartition(3)
    got = exact_dedup.copies(df).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        g = groups[r.text or ""]
        keep = max((i for i in g if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(g), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest())
    kept = sorted(r.doc_id for r in exact_dedup.dedup(df).collect())
    assert kept == [3, 4, 5, 8, 9, 10]
    assert exact_dedup.copies(df.limit(0)).count() == 0


def test_exact_dedup_by_shuffle_equals_broadcast(spark, sf_dir, monkeypatch):
    a = sorted(map(tuple, exact_dedup.query(spark, sf_dir).collect()))
    monkeypatch.setattr(exact_dedup, "is_small", lambda df: False)
    assert sorted(map(tuple, exact_dedup.query(spark, sf_dir).collect())) == a


def test_clashing_columns(spark):
    df = docs(spark, [(1, "a b c d", "s"), (2, "a b c d", "s")]).withColumns({"KEPT": F.lit(9), "score": F.lit("x"), "component_id": F.lit(3), "n_dropped": F.lit(1), "ids": F.lit(0), "verdict": F.lit("q"), "Id": F.lit(4), "fp": F.lit(5), "t": F.lit(6), "_copies": F.lit(7), "size": F.lit(8)})
    assert [r.kept for r in exact_dedup.copies(df).orderBy("doc_id").collect()] == [False, True]
    assert [r.kept for r in near_dedup.near_copies(df).orderBy("doc_id").collect()] == [True, False]
    assert line_dedup.drop_boilerplate(df).count() == 2 and bpe.tokenize(df).count() == 2 and mixing.mixed(df).count() > 0
    assert exact_dedup.dedup(df).columns == [c for c in df.columns]
    assert language_id.known_only(df).count() == 2


# --- near dedup


def brute_near(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_dedup_against_brute_force(spark, size, percent):
    rng = random.Random(5)
    texts, n = {}, 0
    for _ in range(25):
        base = words(rng, rng.choice([1, 2, 4, 30, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts[n] = " ".join(w) if rng.random() < 0.7 else "\t".join(w).upper()
            n += 1
    texts |= {n: None, n + 1: "", n + 2: " \n ", n + 3: texts[0]}
    got = by_id(near_dedup.near_copies(docs(spark, [(i, t, "s") for i, t in texts.items()]), size=size, threshold=percent / 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near(texts, size, percent)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_dedup_chain_of_one_bucket(spark, monkeypatch):
    """A chain whose ends aren't alike: stars alone would leave it in pieces; blocks of two members must find the rest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = random.Random(6)
    w, texts = words(rng, 120).split(), {}
    for i in range(12):
        texts[i] = " ".join(w)
        for k in range(3):
            w[(i * 3 + k) * 3 % 120] = f"new{i}x{k}"
    got = by_id(near_dedup.near_copies(docs(spark, [(i, t, "s") for i, t in texts.items()]), size=3, threshold=0.85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near(texts, 3, 85)


def test_near_dedup_edges(spark):
    df = docs(spark, [(None, "one two three", "s"), (3, "one two three", "s"), (3, "one two three", "s"), (4, "one two three", "s")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_copies(df.select("doc_id", "text")).collect())
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 4, 3, False), (True, 0, None, True)]
    assert near_dedup.near_copies(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in near_dedup.dedup(df).collect()) == [0, 3, 3]


def test_odd_sketch_estimates():
    r = np.random.default_rng(7)
    s = r.integers(0, 2**64, 2000, dtype=np.uint64)
    for share in (0.95, 0.9, 0.85):
        k = int(2000 * (1 - share) / (1 + share))
        a, b = np.unique(s[: 2000 - k]), np.unique(s[k:])
        off = np.bitwise_count((near_dedup.odd_sketch(near_dedup.minhash(a)) ^ near_dedup.odd_sketch(near_dedup.minhash(b))).view(np.uint64)).sum()
        assert off <= near_dedup.odd_limit(0.85)
    other = r.integers(0, 2**64, 2000, dtype=np.uint64)
    off = np.bitwise_count((near_dedup.odd_sketch(near_dedup.minhash(s)) ^ near_dedup.odd_sketch(near_dedup.minhash(other))).view(np.uint64)).sum()
    assert off > near_dedup.odd_limit(0.85)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = by_id(components.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")), "id")
    up = {x: x for e in edges for x in e}
    for _ in range(50):
        for a, b in edges:
            m = min(up[a], up[b])
            up[a] = up[b] = m
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {i: r.component for i, r in got.items()} == {i: up[i] for i in linked}


# --- embeddings


def test_graph_recall():
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x[:300] = x[0] + 0.1 * r.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    again = hnsw.Graph(x, g.links)
    found = embedding_dedup.audited(again, x[:400], 0.9)
    true = x[:400] @ x.T >= 0.9
    assert sum(true[i][f].sum() for i, f in enumerate(found)) >= 0.99 * true.sum()


def test_graph_audit_without_links(monkeypatch):
    """The sampled queries have no link but themselves, and a narrow beam misses many of the others' links."""
    r = np.random.default_rng(9)
    x = r.normal(size=(8000, 128)).astype(np.float32)
    x[4000:4300] = x[:300] + 0.3 * r.normal(size=(300, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[r.permutation(8000)]
    monkeypatch.setattr(embedding_dedup, "BEAM", 2)
    true = [np.flatnonzero(s >= 0.9) for s in x @ x.T]
    pairs, lone = [[i for i, t in enumerate(true) if (len(t) > 1) == k] for k in (True, False)]
    asked = np.zeros(600 + embedding_dedup.AUDITED, int)
    sample = np.linspace(0, len(asked) - 1, embedding_dedup.AUDITED).astype(int)
    asked[sample] = lone[: len(sample)]
    asked[np.setdiff1d(np.arange(len(asked)), sample)] = pairs
    found = embedding_dedup.audited(hnsw.Graph(x), x[asked], 0.9)
    assert len(pairs) == 600 and sum(len(np.setdiff1d(true[i], f)) for i, f in zip(asked, found)) <= 6


def test_embedding_dedup(spark):
    r = np.random.default_rng(10)
    base = r.normal(size=(40, 16))
    v = [base[i % 40] * (1 + i % 3) + (0.05 if i < 160 else 0.6) * r.normal(size=16) for i in range(240)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500 + i, v[0].tolist()) for i in range(5)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = by_id(embedding_dedup.near_copies(df), "vec_id")
    ids, m = [i for i, _ in rows], np.array([x for _, x in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    comp = list(range(len(ids)))
    for _ in range(60):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    for i, d in enumerate(ids):
        assert (got[d].n_links, got[d].component_id) == (near[i].sum(), ids[comp[i]]), d
    assert [(got[i].n_links, got[i].component_id) for i in range(900, 907)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (1, 905), (1, 905)]
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


def test_embedding_dedup_visits(spark, monkeypatch):
    """A vector goes to few cells and not to all shards; pairs just over the bound meet, and links of several shards count once for each end."""
    monkeypatch.setattr(embedding_dedup, "LEAST", 500)
    monkeypatch.setattr(embedding_dedup, "PART", 1 << 12)
    r = np.random.default_rng(12)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(r.normal(size=(4000, 48)))
    away = r.normal(size=(1000, 48))
    away = unit(away - (away * x[:1000]).sum(1, keepdims=True) * x[:1000])
    x = np.concatenate([x, 0.91 * x[:1000] + np.sqrt(1 - 0.91**2) * away, unit(x[5] + 0.02 * r.normal(size=(300, 48)))])
    ids = r.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    points = df.selectExpr("vec_id as id", "embedding as v", "size(embedding) as dim", "1L as weight")
    index = embedding_dedup._index(points, 0.9)
    leaders, _, _, shards = index[48]
    assert len(set(shards)) == 8 and len(leaders) > 200
    routed = pa.Table.from_batches(embedding_dedup._route(index)(points.select("id", "dim", "weight", "v").toArrow().to_batches())).sort_by("id")
    home, cells, goes = (routed[n].to_pylist() for n in ("home", "cells", "goes"))
    assert np.mean([len(c) for c in cells]) < len(leaders) / 8 and np.mean([len(g) for g in goes]) < 7
    assert all(set(shards[c]) == set(g) and h in c for h, c, g in zip(home, cells, goes))
    pairs = list(zip(ids[:1000].tolist(), ids[4000:5000].tolist()))
    assert sum(home[a] in cells[b] or home[b] in cells[a] for a, b in pairs) >= 985
    got = by_id(embedding_dedup.near_copies(df), "vec_id")
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[int(i)].n_links for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    assert links[5000:].min() >= 299 and len({got[int(ids[i])].component_id for i in range(5000, 5300)}) == 1


# --- BPE


def test_bpe_equals_the_library():
    import public_tokenizers as P
    import tiktoken

    own = bpe.codec(*bpe.public_vocabulary())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.bpe.ranks, special_tokens={})
    rng = random.Random(11)
    alphabets = ["abcdefghijklmnop", "aeiou thn", "日本語中国한국어abc", "\U0001f600́é ", "01234", "$%#!. \n\t", "'s't aA"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for s in [*texts, "", "a" * 3000, "ab" * 2000, "$" * 3000, " " * 2000, "日" * 700, "<|endoftext|>"]:
        ids = own.encode(s)
        assert ids == ref.encode_ordinary(s) and own.decode(ids) == s.encode()


def merged(b, piece):
    """Lowest rank first, leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((b.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_bpe_pairs_stay_apart_as_merging_says():
    b, rng = bpe.codec(*bpe.public_vocabulary()).bpe, random.Random(3)
    cuts = [(w[:i], w[i:]) for w in rng.sample(sorted(b.ranks), 3000) for i in range(1, len(w))]
    pairs = [(b.ranks[x], b.ranks[y]) for x, y in cuts if x in b.ranks and y in b.ranks]
    pairs += [(rng.randrange(n), rng.randrange(n)) for n in (400, 3000, len(b.bytes_of)) for _ in range(4000)]
    want = [merged(b, b.bytes_of[x] + b.bytes_of[y]) == [b.bytes_of[x], b.bytes_of[y]] for x, y in pairs]
    assert b.all_stay(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])).tolist() == want and 1000 < sum(want) < len(want) - 1000


def test_bpe_forgets_and_goes_on(monkeypatch, spark, sf_dir):
    """Small memories, and texts longer than what is in hand at once, on the documents of the tables."""
    import public_tokenizers as P
    import tiktoken

    for name, n in (("PIECES", 300), ("PAIRS", 200), ("TOGETHER", 5000)):
        monkeypatch.setattr(bpe, name, n)
    own = bpe.Codec(*bpe.public_vocabulary())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.bpe.ranks, special_tokens={})
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [" ".join(texts[:20]), "", "x" * 20_000, "  \n " * 3000]
    assert [np.frombuffer(p, np.int32).tolist() for p in own.pack(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_bpe_edits_and_appends():
    b = bpe.codec(*bpe.public_vocabulary()).bpe
    old, new = b"internationalization", b"internationalisations"
    table = b.extend(old, [-1])
    assert b.walk(new, b.edited(old, table, new)) == b.piece(new) and b.walk(old, table) == b.piece(old)


def test_bpe_rows(spark):
    df = docs(spark, [(1, None, "s"), (2, "", "s"), (3, "Hello, wörld", "s"), (3, "Hello, wörld", "s")])
    got = bpe.tokenize(df).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and bytes(got[2].decoded).decode() == "Hello, wörld" and got[2].ids == got[3].ids
    d = bpe.digests(bpe.tokenize(df)).orderBy("doc_id").collect()
    assert d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[2].ids_sha256 == hashlib.sha256(",".join(map(str, got[2].ids)).encode()).hexdigest()
    assert bpe.tokenize(df.limit(0)).count() == 0


def test_bpe_with_unreachable_tokens():
    """A vocabulary with a token that no merge makes: it stands for its own piece and for nothing else."""
    own = bpe.PrefixBPE({**{bytes([i]): i for i in range(256)}, b"ab": 256, b"abc": 257, b"xyz": 258})
    assert own.piece(b"xyz") == [258] and own.piece(b"xyzz") == [120, 121, 122, 122] and own.piece(b"abcab") == [257, 256]


# --- mixing


def test_mix(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 300])), None if i % 5 == 4 else f"s{i % 5}" if i % 2 else "s0") for i in range(900)] + [(2000, None, "s0"), (2001, "", "s1"), (2001, "", "s1")]
    got = mixing.decide(docs(spark, rows)).collect()
    again = {(r.doc_id, r.taken) for r in mixing.decide(docs(spark, rows).repartition(7)).collect()}
    assert len(got) == len(rows) and {(r.doc_id, r.taken) for r in got} == again
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    while True:  # the contract's words: what is above the cap is shared anew by weight
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(3, 0.01 * target[s])
    assert all(r.taken <= 2 * r.size and r.copies in (0, 1, 2) for r in got)
    assert mixing.decide(docs(spark, rows).limit(0)).count() == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(13)
    z, p = r.integers(1, 500, 200), np.full(200, 0.3)
    q = mixing.fly(z, p, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ z - p @ z) < 1e-3


def test_mixed_rows_repeat(spark):
    df = docs(spark, [(i, "a b c d", "s0" if i < 10 else "s1") for i in range(40)])
    own = {r.doc_id: r.copies for r in mixing.decide(df).collect()}
    out = [r.doc_id for r in mixing.mixed(df).collect()]
    assert {i: out.count(i) for i in own} == own


# --- lines


def test_line_dedup_both_ways(spark):
    rows = [(i, f"Menu\nown line {i}\n\n Menu \nshared", "a") for i in range(10)] + [(100 + i, f"Menu\nline {i}", "b") for i in range(60)] + [(200, None, "a"), (201, "", "b"), (202, "Menu", None)]
    for most in (1000, 0):
        got = by_id(line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.5, broadcast_lines=most))
        assert len(got) == len(rows)
        assert (got[3].text, got[3].n_lines, got[3].n_dropped) == ("own line 3\n", 5, 3)
        assert got[105].text == "line 5" and got[200].text is None and got[201].text == "" and got[202].text == "Menu"
    assert line_dedup.drop_boilerplate(docs(spark, rows).limit(0)).count() == 0


# --- urls


def test_url_rules(spark):
    urls = {
        "https://example.com/en/73?x": ("example.com", "/en/73", "example.com/en/7", "allow"), "http://A.Example.COM/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
        "http://x.example.net/de/8": ("x.example.net", "/de/8", "example.net/de/8", "block"), "http://net/de/": ("net", "/de/", "net/", None), "http://n.org/es/#a": ("n.org", "/es/", "org/es/", "block"),
        "http://ncom/en/1": ("ncom", "/en/1", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://spam-farm.example.org/en/": ("spam-farm.example.org", "/en/", None, "block"),
        "http://h.com/EN/1": ("h.com", "/EN/1", None, "allow"), "http://h.com?q=/en/": ("h.com", "", None, "allow"), "://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
    }
    urls["http://net/de/"] = ("net", "/de/", "net/de/", "allow")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()}
    assert got == urls


def test_url_index_equals_all_rules():
    rng = random.Random(14)
    index = url_filter.Index(url_filter.RULES, {})
    parts = ["com", "net", "org", "example", "en", "de", "es", "7", "8", "casino", "pills", "cheap", "wp-login", "cgi-bin", "x"]
    for _ in range(3000):
        u = "http://" + ".".join(rng.choices(parts, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) + rng.choice(["", "/"])
        host, path = url_filter.parts(u)
        fits = [r for r in url_filter.RULES if r.search(host + path)]
        listed = max((r for r in fits if r.listed), key=lambda r: r.weight, default=None)
        got = index.judge(u)
        assert got[2] == (listed and listed.name) and got[4] == (listed.verdict if listed else "block" if fits else "allow")


# --- html


def test_html():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if(a<b)"</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id=cookie-notice>We use cookies on this site. Accept them all, please.</div><article><h1>Caf&eacute; &amp; co</h1><p>One   two<br>three.<p>Of.</p><div class="ad">Buy now! Best price today.</div><p>x &lt; y <b>bo</b>ld
    <script>var x = "<p>no</p>"</script>end.</p><form><input><button>Send</button></form><section class=comments><p>First! Great article, thanks.</p></section></article><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""
    assert html_extract.extract(page) == "Café & co One two three. Of. x < y bold end."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p") == ""
    assert html_extract.extract('<main><div class="entry-header"><h1>Title</h1></div><p>Text.</p><div class="entry-footer">Filed under x</div></main>') == "Title Text."
    assert html_extract.extract("<article><p>unclosed <i>text") == "unclosed text"
    plain = "<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>" + "Long words stand here, as prose does. " * 8 + "<p>Short.</p><p>" + "More prose follows after that one. " * 8 + "</p><div><a href=c>Prev</a> <a href=d>Next</a></div>"
    got = html_extract.extract(plain)
    assert "Short." in got and "One" not in got and "Next" not in got
    assert len(html_extract.extract("<article>" + "<p>a b</p>" * 20_000)) == 79_999


def test_declared_language_after_a_long_comment(spark):
    page = "<!-- " + "x " * 5000 + "--><html class=a lang='de-AT'><p>Text"
    assert [r[0] for r in spark.createDataFrame([(page,), ("<p lang=fr>x",), (None,)], "html string").select(language_id.declared(F.col("html"))).collect()] == ["de", None, None]


def test_html_names():
    extract = html_extract.extract
    for inner in ("<main><p>The text.</p></main>", "<article><p>The text.</p></article>"):
        for outer in ("class='content-sidebar-wrap'", "class='layout has-sidebar'", "class='sidebar'", "id=widget"):
            assert extract(f"<div class=menu><p>Home</p></div><div {outer}>{inner}</div>") == "The text."
    parts = "<h2 id='side-effects'>Side effects</h2><h2 id='legal'>Law</h2><section id='discussion'><p>We find.</p></section><section id=comments><p>On comments.</p></section><div class='footnotes'><p>1. A note.</p></div><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>"
    assert extract(f"<article>{parts}</article>") == "Side effects Law We find. On comments. 1. A note. So x=2 holds."
    assert extract("<article><p>The text.</p></article><div class=sidebar><article><p>Another teaser stands here.</p></article></div>") == "The text."
    assert extract("<article><p>The text.</p><div class=ad><p>" + "Buy this now, it is the best. " * 9 + "</p></div><ul class=related><li><a href=a>Some other long story</a></ul></article>") == "The text."
    assert extract("<article><p>The text.</p><div id=comments><p>First! A great article.</p></div></article>") == "The text."
    assert extract("<div hidden><main><p>Unseen.</p></main></div>") == ""
    prose = "Long words stand here, as prose does. " * 8
    assert extract(f"<div class='page sidebar'><p>{prose}</p></div>") == prose.strip()


def test_html_wrappers_and_attributes():
    extract, prose = html_extract.extract, "Real sentences stand here with words enough. And more of them follow, as they do. " * 3
    want = prose.strip()
    assert extract(f'<div class="page has-sidebar"><article><p>{prose}</article></div>') == want
    assert extract(f'<div id="content-sidebar-wrap"><main><p>{prose}</main></div>') == want
    assert extract(f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><div><p>{prose}</p></div></form><footer>&copy; us</footer></body>") == want
    assert extract(f'<article class="hentry category-search"><p>{prose}</article>') == want
    assert extract(f'<article><p title="the hidden truth">{prose}<p data-hidden=1>So it is.<p hidden>No.<p style="color:red; display : none">No.<p aria-hidden="true">No.</article>') == want + " So it is."
    assert extract("<form>Name <input> Password <input></form>") == extract("<nav>Home</nav><footer>All of it is ours. It is.</footer>") == ""
    assert extract(f"<article><p>{prose}<p><a href=x>Read the source</a></article>") == want + " Read the source"


def test_html_in_linear_time():
    import time

    for bad in ("<a ", '<a "', "<div>", "</span>", "<!--", '<p title="x', "<b><table>", "<div></p>", "<p>x"):
        began = time.perf_counter()
        html_extract.extract(bad * (300_000 // len(bad)))
        assert time.perf_counter() - began < 5, bad


def test_cut_changes_labels_of_pages(spark, sf_dir):
    """Short blocks whose own signs are against them, on pages of the tables, are kept for their neighbours."""
    changed = 0
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/pages.parquet").filter("length(html) < 1500").select("html").collect():
        _, prices, near = html_extract.priced(r.html or "")
        changed += sum((p > 0) != k for p, k in zip(prices, html_extract.cut_labels(prices, near)))
    assert changed > 0


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", "<p>One.", 5, "x"), (1, "u", "<p>One.", 5, "x"), (2, None, None, None, None), (3, "u", "<article>" + "<p>a b" * 300_000, 1, "y")], "page_id long, url string, html string, N_chars int, TEXT string")
    got = html_extract.extract_text(d).orderBy("page_id").collect()
    assert [(r.page_id, r.text[:4], r.n_chars) for r in got] == [(1, "One.", 4), (1, "One.", 4), (2, "", 0), (3, "a b ", 1_199_999)]
    assert html_extract.extract_text(d.limit(0)).count() == 0


def test_cut_is_least():
    rng = random.Random(15)
    for _ in range(60):
        n = rng.randint(1, 8)
        prices = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.5]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.5, 1.0, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        cost = lambda x: sum(max(0, p) * (not k) + max(0, -p) * k for p, k in zip(prices, x)) + sum(w * (x[i] != x[j]) for i, j, w in edges)
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.cut_labels(prices, edges)) - best) < 1e-9


def test_html_pages(spark, sf_dir):
    import html as h
    import re

    got = by_id(html_extract.query(spark, sf_dir), "page_id")
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.search(r"<article>(.*)</article>", r.html, re.S)
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", m[1]))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(700):
        bad = i % 5 == 2
        w = words(rng, 40).split()
        if bad:
            for x in rng.choices(["moron", "scum", "vexaro", "vexane"], k=3):
                w[rng.randrange(40)] = x
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 0, int(bad) if zlib.crc32(str(i).encode()) % 5 else int(not bad)))  # held-out labels lie: they must not be learned
    df, lab = docs(spark, [*rows, (800, None, "s"), (801, "", "s"), (None, "moron", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(df, toxicity.train(df, lab)))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [i for i, *_ in rows if got[i].held_out]
    assert sum(got[i].predicted == (i % 5 == 2) for i in held) >= 0.97 * len(held)
    assert 0 <= got[800].score == got[801].score < 0.5 and got[800].predicted == 0
    none = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}


# --- language


def test_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id")
    assert got.filter("language = lang and kept").count() >= 0.98 * d.count()
    more = docs(spark, [(90_001, None, None), (90_002, "", "x"), (90_003, "12 !! ###", "x"), (90_004, "the of and to", None)])
    out = by_id(language_id.identify(d.unionByName(more)).filter("doc_id > 90000"))
    assert [out[i].kept for i in range(90_001, 90_005)] == [False, False, False, True]
    assert language_id.known_only(d.limit(0)).count() == 0


def test_language_evidence(spark):
    """A text that says little is settled by its host and its declared tag."""
    rows = [(i, "h1", "d", "s", "de", [0.0, -50.0]) for i in range(50)] + [(100 + i, "h2", "d", "s", "en", [-50.0, 0.0]) for i in range(50)] + [(1, "h1", "d", "s", None, [0.0, 0.0]), (2, "h2", "d", "s", None, [0.0, 0.0]), (3, None, None, None, "de", [0.0, 0.0])]
    df = spark.createDataFrame([(1000 + i if i > 3 else i, *r) for i, *r in rows if i > 3 or r[-1] == [0.0, 0.0]], "doc_id long, host string, domain string, suffix string, declared string, ll array<double>")
    got = by_id(language_id.fuse(df, ["de", "en"]))
    assert (got[1].language, got[2].language, got[3].language) == ("de", "en", "de")


def fused_by_hand(rows, tags, k, start):
    """rows: (host, domain, suffix, declared, ll or None) -> posteriors by class, or None."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    alone = [None if r[4] is None else soft(np.array(r[4]) + np.log(start)) for r in rows]
    told = [(r, q) for r, q in zip(rows, alone) if q is not None]
    top = (sum(q for _, q in told) + k * np.array(start)) / (len(told) + k)

    def prior(host, own):
        p = top
        for part in (host[2:], host[1:], host):  # suffix; domain and suffix; all three
            n = sum((q for r, q in told if r[3 - len(part) : 3] == part), np.zeros(k))
            if part == host:
                n = np.maximum(n - own, 0)
            p = (n + language_id.SMOOTH * p) / (n.sum() + language_id.SMOOTH)
        return p

    by_tag = {t: sum((q for r, q in told if r[3] == t), np.zeros(k)) for t in tags}
    total = sum(by_tag.values()) + language_id.TAG * (len(by_tag) + 1)
    out = []
    for r, q in zip(rows, alone):
        if q is None:
            out.append(None)
            continue
        tag = np.log((by_tag[r[3]] + language_id.TAG) / total) if r[3] in by_tag else 0
        out.append(soft(np.log(prior(r[:3], q)) + np.array(r[4]) + tag))
    return out


def test_language_query_by_hand(spark, tmp_path, sf_dir):
    """Documents and pages with tags, hosts, suffixes, foreign texts and noise, against plain numpy."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang in ('fr', 'en')").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in known]
    rows += [(900_001, "xqzvk wqjx zzpt kkqw vbnm qwrt plkj hgfd zxcv mnbv", None, "src0"), (900_002, "Tämä on suomenkielinen lause maailmasta ja sen ihmisistä", None, "src1"), (900_003, None, None, None), (900_004, "", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [r.text for r in known]
    pages = [(i, f"http://{'abc'[i % 3]}.x{i % 2}.{'fr' if i % 2 else 'com'}/p", f"<!-- <p> --><HTML lang='{'fr-CA' if known[i].lang == 'fr' else 'en'}'><style>p{{a}}</style><p>{texts[i][:200]}</p>") for i in range(20)]
    pages += [(50, None, "<p>&eacute; le</p>"), (51, "http://a.x1.fr/", None), (52, "nothing", "<html><p>12 !!"), (53, "http://a.x1.fr/", "<html lang=fr>le"), (53, "http://a.x1.fr/", "<html lang=fr>le"), (54, "http://a.x1.fr/", "<b>" + "wqjx zzpt kkqw " * 20_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    languages = ["en", "fr"]
    counts = np.zeros((2, language_id.BUCKETS), np.int64)
    for r in known:
        counts[languages.index(r.lang)] += np.bincount(language_id.trigrams(r.text, False), minlength=language_id.BUCKETS)
    logs = language_id.log_shares(counts)

    def ll(text, markup):
        g = language_id.trigrams(text, markup)
        return (logs[g].mean(0) * min(len(g), language_id.EFFECTIVE)).tolist() if len(g) else None

    evidence = [(i, None, (s, s, None, None, ll(t, False))) for i, t, _, s in rows]
    for i, url, page in pages:
        host = url.split("://")[1].split("/")[0] if url and "://" in url else None
        tag = None if not page or "lang=" not in page else "fr" if "fr" in page.split("lang=")[1][:4] else "en"
        evidence.append((None, i, (host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], tag, ll(page, True))))
    want = []
    for (d, p, _), f in zip(evidence, fused_by_hand([e[2] for e in evidence], ["fr", "en"], 3, [0.495, 0.495, 0.01])):
        kept = f is not None and bool(f[2] <= 0.5)
        best = int(np.argmax(f[:2])) if kept else None
        want.append((str(d), str(p), kept, languages[best] if kept else None, round(float(f[best]), 6) if kept else None))
    got = [(str(r.doc_id), str(r.page_id), r.kept, r.language, None if r.posterior is None else round(r.posterior, 6)) for r in language_id.query(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = {r[:2]: r[2] for r in got}
    assert not kept["900001", "None"] and not kept["900002", "None"] and not kept["None", "54"] and all(kept[str(r.doc_id), "None"] for r in known)


def test_language_edges(spark, tmp_path):
    d = spark.createDataFrame([(1, "the of and to", "en", "s", 1.0, True), (1, "the of and to", "en", "s", 1.0, True), (2, "le la les des", "fr", "s", 2.0, None)], "doc_id long, text string, lang string, source string, Posterior double, kept boolean")
    out = language_id.known_only(d)
    assert out.columns == d.columns and out.count() == 3
    d.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert language_id.query(spark, str(tmp_path)).count() == 0


def test_markup_and_tags_in_linear_time():
    import time

    for bad in ("<!--", "<html ", "<a ", "<script", "&a", "<"):
        began = time.perf_counter()
        language_id.trigrams(bad * (1_000_000 // len(bad)), True)
        assert time.perf_counter() - began < 5, bad


def test_exact_dedup_beyond_what_is_sent_to_all(spark, monkeypatch):
    """Many suspects: only they, and few others, are grouped by their bytes; heavy groups and repeats come out the same."""
    rng = random.Random(4)
    rows = [(i, f"text {i}", "s") for i in range(3000)] + [(3000 + i, f"pair {i // 2}", "s") for i in range(400)] + [(4000 + i, "hot", "s") for i in range(900)] + [(None, "hot", "s"), (7, None, "s"), (7, "", "s"), (8, "pair 3", "s")]
    rng.shuffle(rows)
    df = docs(spark, rows).repartition(5)
    want = sorted(map(repr, exact_dedup.copies(df).collect()))
    monkeypatch.setattr(exact_dedup, "is_small", lambda *_: False)
    monkeypatch.setattr(exact_dedup, "HEAVY", 100)
    assert sorted(map(repr, exact_dedup.copies(df).collect())) == want
    prints = df.withColumn("_fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = prints.groupBy("_fp").count().filter("count > 1").select(F.col("_fp").alias("fp"))
    moved = exact_dedup.sieved(prints, "_fp", found, 1 << 15).filter("_maybe")
    suspects = prints.join(found, F.col("_fp") == F.col("fp"), "left_semi")
    assert moved.join(suspects.select("_fp"), ["_fp"], "left_semi").count() == suspects.count() == 1304 and moved.count() < 1304 + 3000 / 20


def test_near_dedup_strangers_in_a_bucket_of_copies(spark, monkeypatch):
    """One large component and strangers that link with parts of it, in small blocks; every bucket holds all."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "K", 16)
    monkeypatch.setattr(near_dedup, "band_rows", lambda *_: 1)
    monkeypatch.setattr(near_dedup, "odd_limit", lambda *_: 1 << 20)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = {1: " ".join(base)}
    for i in range(2, 40):  # a chain that drifts away: neighbours link, its ends don't
        base[rng.randrange(120)] = f"v{i}"
        base[rng.randrange(120)] = f"u{i}"
        texts[i] = " ".join(base)
    for i in range(50, 56):
        texts[i] = " ".join([f"w{k}" for k in range(60 + i % 3)] + [f"x{i // 2}{k}" for k in range(70)])
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts.items() for w in [t.split()]}
    up = {i: i for i in texts}
    top = lambda x: x if up[x] == x else top(up[x])
    for a in texts:
        for b in texts:
            if a < b and 100 * (both := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = by_id(near_dedup.near_copies(docs(spark, [(i, t, "s") for i, t in texts.items()]), size=3, threshold=0.85))
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in texts}


def test_near_dedup_ids_with_several_texts(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randrange(500)}" for _ in range(200)) for k in "abc")
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " more", "s"), (8, b + " more", "s"), (9, c, "s"), (9, None, "s"), (9, c, "s"), (3, "", "s")]
    for d in (docs(spark, rows), docs(spark, rows).select("doc_id", "text")):
        got = sorted((r.doc_id, r.text[:1] if "text" in d.columns and "source" in d.columns and r.text else "", r.component_id, r.kept) if "source" in d.columns else (r.doc_id, r.component_id, r.kept) for r in near_dedup.near_copies(d, size=3, threshold=0.85).collect())
        assert [(x[0], *x[-2:]) for x in got] == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True), (9, 9, True)]


def test_embedding_dedup_ids_with_several_vectors(spark, monkeypatch):
    """Rows that repeat an id with another vector link by both; other columns stay, clashing ones give way; parts and graphs of several shards."""
    monkeypatch.setattr(embedding_dedup, "PART", 8 * 4 * 3)
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(5, a, "p", 1), (5, b, "q", 2), (7, near(a), "r", 3), (8, near(b), "s", 4), (9, c, "t", 5), (9, c, "t", 5), (4, near(c), "u", 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, KEPT int")
    got = embedding_dedup.near_copies(df)
    assert got.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"]
    assert sorted((r.label, r.n_links, r.component_id, r.kept) for r in got.collect()) == [("p", 1, 5, True), ("q", 1, 5, True), ("r", 1, 5, False), ("s", 1, 5, False), ("t", 2, 4, False), ("t", 2, 4, False), ("u", 2, 4, True)]


def label_model_by_hand(votes, start, rounds):
    """EM over voters as plain loops: (prior, fires by label, share by voter, posterior by row)."""
    n, m = len(votes), len(votes[0])
    post = list(start)
    for _ in range(rounds):
        mass = [sum(1 - p for p in post), sum(post)]
        mean = [[sum((1 - p if k == 0 else p) * v[j] for p, v in zip(post, votes)) / mass[k] for j in range(m)] for k in (0, 1)]
        left = [[v[j] - ((1 - p) * mean[0][j] + p * mean[1][j]) for j in range(m)] for p, v in zip(post, votes)]
        sd = [(sum(r[j] ** 2 for r in left) / n) ** 0.5 + 1e-9 for j in range(m)]
        corr = [[sum(r[i] * r[j] for r in left) / n / sd[i] / sd[j] for j in range(m)] for i in range(m)]
        share = [1 / max(1.0, sum(corr[i][j] for i in range(m) if corr[i][j] > 0.3)) for j in range(m)]
        prior = (mass[1] + 1) / (n + 2)
        fires = [[(mean[k][j] * mass[k] + 0.5) / (mass[k] + 1) for j in range(m)] for k in (0, 1)]
        post = []
        for v in votes:
            logit = np.log(prior / (1 - prior)) + sum(share[j] * np.log(fires[1][j] / fires[0][j]) for j in range(m) if v[j])
            post.append(1 / (1 + np.exp(-min(30, max(-30, logit)))))
    return prior, fires, share, post


def test_label_model_by_hand():
    rng = random.Random(21)
    truth = [rng.random() < 0.3 for _ in range(120)]
    votes = [[int(rng.random() < (0.7 if t else 0.05)), 0, int(rng.random() < (0.5 if t else 0.1)), int(rng.random() < 0.2)] for t in truth]
    for v in votes:
        v[1] = v[0]  # the same voter again
    start = [0.9 if v[0] or v[2] else 0.02 for v in votes]
    model = toxicity.LabelModel().fit(np.array(votes, np.uint8), np.array(start), rounds=4)
    prior, fires, share, post = label_model_by_hand(votes, start, 4)
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.fires, fires) and np.allclose(model.share, share) and np.allclose(model.posterior(np.array(votes)), post)
    assert abs(share[0] - share[1]) < 1e-9 and share[0] < 0.6 and share[3] > 0.9


def test_toxicity_edges(spark):
    """Rows that repeat, labels that contradict each other, clashing columns, a very long text, no rows at all."""
    rng = random.Random(22)
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5]
    bad = [i for i in ids if i % 4 == 0]
    text = lambda i: words(rng, 30) + (" vile nasty" if i % 4 == 0 else "")
    rows = [(i, text(i), 9.0, "x") for i in ids]
    rows += [(ids[0], rows[0][1], 9.0, "x"), (9_001, "vile nasty " * 100_000, None, None), (9_002, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE double, predicted string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in ids] + [(bad[0], 0), (None, 1), (ids[1], None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    again = toxicity.train(df.repartition(5), labels.repartition(3))
    assert model["names"] == again["names"] and np.allclose(model["weights"], again["weights"], atol=1e-6)
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score", "held_out", "predicted"] and out.count() == len(rows)
    got = out.collect()
    assert len({r.score for r in got if r.doc_id == ids[0]}) == 1 and by_id(out)[9_001].predicted == 1 and by_id(out)[9_002].predicted == 0
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), labels)).count() == 0


def test_mix_edges(spark):
    """A third of the rows without an id, a very long text, clashing columns."""
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 50), "a" if i % 2 else "b") for i in range(6000)] + [(9_999, "w " * 20_000, "a")]
    df = docs(spark, rows).withColumn("SIZE", F.lit("x"))
    got = mixing.decide(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target and all(r.copies <= 2 for r in own)
    again = mixing.decide(df.repartition(9)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_lines_and_urls_edges(spark):
    long = "x" * 3_000_000
    rows = [(i, f"{long}\nown {i}", "a") for i in range(6)] + [(7, None, None), (7, None, None)]
    got = line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.5).filter("source = 'a'").collect()
    assert {r.text for r in got} == {f"own {i}" for i in range(6)}
    d = spark.createDataFrame([(1, "http://com/en/x", "old", 1), (1, "http://com/en/x", "old", 1), (2, "http://a.com/" + "y/" * 300_000, None, 2), (3, None, None, None)], "page_id long, url string, HOST string, verdict int")
    out = url_filter.judge(d)
    assert [c for c in out.columns if c.lower() == "host"] == ["host"] and sorted((r.page_id, r.verdict) for r in out.collect()) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    assert url_filter.judge(d.limit(0)).count() == 0


def test_near_dedup_of_a_very_long_text(spark):
    rng = random.Random(23)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    got = by_id(near_dedup.near_copies(docs(spark, [(1, long, "s"), (2, long.upper() + " tail", "s"), (3, "w1 w2", "s")]), size=3, threshold=0.85))
    assert (got[2].component_id, got[3].component_id, got[1].n_shingles) == (1, 3, 199_998)


def test_scores_are_brought_to_the_labels_scale():
    rng = np.random.default_rng(3)
    label = (rng.random(4000) < 0.1).astype(int)
    logit = np.where(label, -2.0, -4.0) + 0.5 * rng.normal(size=4000)
    slope, shift = toxicity.calibration(logit, label)
    told = slope * logit + shift >= 0
    assert slope > 1 and told[label == 1].mean() > 0.95 and told[label == 0].mean() < 0.05
    assert toxicity.calibration(-logit, label) == (1.0, 0.0)
    slope, shift = toxicity.calibration(np.array([-1.0, 1.0, 1.1]), np.array([0, 1, 1]))
    assert 0 < slope < 10
