"""The pipeline, stage by stage, each against brute force on what the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
from rillet.llm import bpe
from rillet.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, scratch = docs.columns, [docs.toPandas()], Scratch(spark, "test")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        kept.append(docs.toPandas())
        assert name == "byte_bpe" or docs.columns == columns
    first, language, exact, near, mix, tokens = kept
    assert len(language) == len(first)  # clean documents stay
    assert sorted(exact.doc_id) == sorted(language.groupby("text").doc_id.max())
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in exact.itertuples() if (w := r.text.encode().lower().split())}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert sorted(near.doc_id) == sorted(i for i in exact.doc_id if i not in up or top(i) == i)
    copies = Counter(mix.doc_id)
    assert set(copies) <= set(near.doc_id) and max(copies.values()) <= 2
    own = bpe.codec(*bpe.public_vocabulary())
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, own.encode(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mix.itertuples())
    assert sorted(zip(tokens.doc_id, tokens.ids_sha256, tokens.decoded_sha256)) == want


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    scratch = Scratch(spark, "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_stages_on_nulls_and_repeats(spark, sf_dir):
    """Nulls in any column, rows that repeat, another column: every stage keeps the columns and does not fail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    some = docs.collect()
    rows = [*some, some[0], (None, some[1].text + " x", "en", None, None), (None, None, None, None, None), (7_000_001, "", None, "src0", 0), (7_000_002, some[2].text, None, None, None)]
    docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    columns, scratch = docs.columns, Scratch(spark, "odd")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        assert name == "byte_bpe" or docs.columns == columns
        assert docs.count() > 30
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r[0] for r in rows}
