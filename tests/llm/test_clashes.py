"""Columns of the caller's that are named like any column inside an operator: results stay, and so do the columns, but for those that clash with the added ones."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from rillet.llm import bpe, collision, common, components, conversations, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, near_dedup, phrases, toxicity, url_filter

TEXTS = ["a b c d e f g", "a b c d e f g", "a b c d e f g h", "stone river cloud", None, "", "you idiot and moron"]


def inner_names(*modules) -> list[str]:
    """All identifiers that stand as strings in the modules' code, as far as they can be told apart by a case-insensitive engine."""
    found = {}
    for m in (*modules, common, components):
        for name in re.findall(r'["`. ]([A-Za-z_][A-Za-z_0-9]*)["`]', inspect.getsource(m)):
            found.setdefault(name.lower(), name)
    return sorted(found.values())


def compare(run, df, module, added):
    """``run`` on df alone and among clashing columns; rows as sets of the df's and the added columns."""
    names = [n for n in inner_names(module) if n.lower() not in {c.lower() for c in df.columns}]
    assert len(names) > 10
    wide = df.withColumns({n: F.lit(f"<{n}>") for n in names})
    before, after = run(df), run(wide)
    assert [c for c in after.columns if c in before.columns] == before.columns
    kept = [n for n in names if n.lower() not in {a.lower() for a in added}]
    assert not set(kept) - set(after.columns)
    key = lambda r: repr([r[c] for c in before.columns])
    rows = after.collect()
    assert sorted(map(key, rows)) == sorted(map(key, before.collect())) and rows
    assert all(r[n] == f"<{n}>" for r in rows for n in kept)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


DOCUMENTS = {
    "copies": (exact_dedup.copies, exact_dedup, exact_dedup.ADDED),
    "dedup": (exact_dedup.dedup, exact_dedup, ()),
    "near_copies": (lambda d: near_dedup.near_copies(d, size=2), near_dedup, near_dedup.ADDED),
    "near_dedup": (lambda d: near_dedup.dedup(d, size=2), near_dedup, ()),
    "lines": (lambda d: line_dedup.drop_boilerplate(d, min_pages=2, ratio=0.1), line_dedup, line_dedup.ADDED),
    "lines_by_join": (lambda d: line_dedup.drop_boilerplate(d, min_pages=2, ratio=0.1, broadcast_lines=0), line_dedup, line_dedup.ADDED),
    "bpe": (lambda d: bpe.tokenize(d).withColumn("decoded", F.hex("decoded")), bpe, ("ids", "n_tokens", "decoded")),
    "toxicity": (lambda d: toxicity.score(d, {"names": ["idiot"], "weights": [2.0], "constant": -1.0}), toxicity, toxicity.ADDED),
}


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents(docs, name):
    run, module, added = DOCUMENTS[name]
    compare(run, docs, module, added)


def test_training_and_mixing(spark, docs):
    wide = docs.withColumns({n: F.lit("x") for n in inner_names(toxicity, mixing, language_id) if n.lower() not in {c.lower() for c in docs.columns}})
    labels = spark.createDataFrame([(i, int(i == 6)) for i in range(7)], "doc_id long, toxic int").withColumns({"text": F.lit("?"), "own": F.lit(0)})
    assert toxicity.train(wide, labels) == toxicity.train(docs, labels.select("doc_id", "toxic"))
    plain, mixed = mixing.mixed(docs), mixing.mixed(wide)
    assert sorted(map(repr, mixed.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
    assert sorted(r.doc_id for r in language_id.known_only(wide).collect()) == sorted(r.doc_id for r in language_id.known_only(docs).collect())


def test_other_tables(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.5]) for i in range(9)], "vec_id long, embedding array<double>")
    compare(lambda d: embedding_dedup.near_copies(d), vectors, embedding_dedup, embedding_dedup.ADDED)
    urls = spark.createDataFrame([(1, "http://a.example.com/en/7"), (2, None)], "page_id long, url string")
    compare(url_filter.judge, urls, url_filter, ("host", "path", "rule", "pattern", "verdict"))
    for run, df, module in (
        (collision.nearest, vectors, collision),
        (conversations.summary, spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string"), conversations),
        (lambda d: phrases.phrases(d, least=1), spark.createDataFrame([("a b", "en")], "text string, lang string"), phrases),
    ):
        wide = df.withColumns({n: F.lit("x") for n in inner_names(module) if n.lower() not in {c.lower() for c in df.columns}})
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(df).collect()))
