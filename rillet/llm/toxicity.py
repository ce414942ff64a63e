"""Toxicity by weak supervision.

1. Terms (words and word beginnings of PREFIXES letters) are counted by label on a sample of labelled training rows, equal texts once;
   those that stand nearly always with the label become lexicon voters, beside a fixed list of insults. Pattern voters (shouting, exclamation marks, symbols, digits) and one voter for
   silence, which speaks when no lexicon voter does, stand beside them.
2. A generative label model takes the votes alone: each round of EM estimates how often each voter fires under either label (its accuracy) and, from
   what the votes have in common beyond the label, their correlations; voters that say the same share one vote's weight.
3. A logistic classifier over terms is trained on the model's posterior labels, and scores every whole text in one scan. Its logits are brought to
   the scale of the sample's labels by two numbers, which leaves the order of scores as it is.

Only the sample's labels are used, from rows whose crc32(id as text) mod 5 isn't 0. The sample has TRAIN rows at most (the first by a hash
of the id), a documented bound; what is collected from it is bounded too, counts of TERMS terms and a row of term numbers a document.
Scoring is per row with bounded memory and no shuffle.

Defined cases: null and empty texts are scored by the classifier's constant; a null id counts as an empty text for the split; several labels of
one id, or of one text, count as their maximum; without two kinds of labels every score is the labels' mean (0 without any); rows that repeat an id are scored
alike; columns that clash with the added ones give way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, apart, held, load

TRAIN, TERMS, VOTERS, SUPPORT, PREFIXES = 16_000, 4000, 300, 4, (3, 4, 5, 6)
#: A mined voter stands with the label in this share of its rows, and beats chance by so many standard deviations.
PRECISION, SURE = 0.8, 4.0
ADDED = ("held_out", "score", "predicted")
WORD = re.compile(r"[^\W\d_]+")
#: Words whose terms a worker remembers.
MEMORY = 500_000
#: Patterns: each votes where its share of the text's characters is over the bound.
PATTERNS = (("shouting", re.compile("[A-Z]"), 0.3), ("exclaiming", re.compile("!"), 0.02), ("symbols", re.compile("[#$%&*@]"), 0.05), ("digits", re.compile(r"\d"), 0.05))


#: Insults that vote without having been mined.
INSULTS = "idiot moron stupid dumb loser trash pathetic scum worthless disgusting clown imbecile cretin jackass bastard asshole bitch whore slut retard faggot scumbag lowlife vermin filth".split()


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked by a star; shorter words have themselves alone."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def term_set(text: str | None) -> set[str]:
    return {t for w in set(WORD.findall((text or "").lower())) for t in terms(w)}


def _count(batches):
    """Partition -> (term, toxic rows, clean rows), summed within the partition."""
    from collections import Counter

    found = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            found[toxic].update(term_set(text.as_py()))
    names = list(found[0].keys() | found[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][n] for n in names], pa.int64()), pa.array([found[0][n] for n in names], pa.int64())], ["term", "pos", "neg"])


class Terms:
    """Numbers of the known terms of a text, with a bounded memory of words."""

    def __init__(self, names: list[str]):
        self.number = {n: i for i, n in enumerate(names)}
        self.words: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        words, out = self.words, set()
        for w in set(WORD.findall((text or "").lower())):
            if (ids := words.get(w)) is None:
                if len(words) > MEMORY:
                    words.clear()
                ids = words[w] = tuple(self.number[t] for t in terms(w) if t in self.number)
            if ids:
                out.update(ids)
        return out


def _describe(names: list[str]):
    def describe(batches):
        known = Terms(names)
        for b in batches:
            ids, shares = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                ids.append(sorted(known.of(text)))
                shares.append([len(p.findall(text)) > most * max(1, len(text)) for _, p, most in PATTERNS])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.bool_())), b.column("toxic")], ["terms", "patterns", "toxic"])

    return describe


class LabelModel:
    """P(vote | label) of voters that speak or abstain, by EM. Abstaining says nothing; correlated voters share weight."""

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 10) -> LabelModel:
        votes = votes.astype(float)
        post = start.astype(float)
        for _ in range(rounds):
            self.share = self._shares(votes, post)
            self.prior = (post.sum() + 1) / (len(post) + 2)
            self.fires = np.stack([((1 - post) @ votes + 0.5) / ((1 - post).sum() + 1), (post @ votes + 0.5) / (post.sum() + 1)])
            post = self.posterior(votes)
        return self

    def _shares(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """1 over the number of voters that say the same: the correlation of what the label leaves unexplained."""
        left = votes - (np.outer(1 - post, (1 - post) @ votes / (1 - post).sum()) + np.outer(post, post @ votes / post.sum()))
        sd = np.sqrt((left**2).mean(0)) + 1e-9
        self.correlation = (left.T @ left) / len(left) / np.outer(sd, sd)
        return 1 / np.maximum(1, np.where(self.correlation > 0.3, self.correlation, 0).sum(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.fires)
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (self.share * (odds[1] - odds[0]))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def logistic(rows: list[list[int]], target: np.ndarray, n: int, ridge: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on sets of terms, by full gradients with per-weight steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([i for r in rows for i in r], np.int64)
    w, b = np.zeros(n), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    square, square_b = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[flat], len(rows)) + b, -30, 30)))
        off = (p - target) / len(rows)
        g, gb = np.bincount(flat, off[at], n) + ridge / len(rows) * w, off.sum()
        square, square_b = square + g**2, square_b + gb**2
        w, b = w - 0.3 * g / np.sqrt(square), b - 0.1 * gb / np.sqrt(square_b)
    return w, b


def calibration(logit: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make a logit a probability of the label, by Newton's steps on a logistic regression of one number; both labels weigh alike in
    sum, so that 0.5 is where neither is likelier than its share. The order of scores stays: without a rising slope the slope is 1."""
    share = label.mean()
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    x = np.stack([logit, np.ones(len(logit))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - label)) + (w - np.array([1.0, 0.0]))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """names and weights of terms, constant; and the label model's voters for inspection."""
    scratch = Scratch(docs.sparkSession, "toxic")
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = scratch.table(known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN), "chosen")
    # TRAIN rows of two numbers: a fixed bound, so they may go to every executor.
    sample = scratch.table(docs.select(F.col(id).alias("own"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("own") == F.col("_id")).select("text", "toxic").groupBy(F.xxhash64("text").alias("print")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        mean = pos / max(1, pos + neg)
        return {"names": [], "weights": [], "constant": float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (40.0 if mean else -40.0), "voters": []}
    counts = sample.select("text", "toxic").mapInArrow(_count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= SUPPORT)
    rate = lambda k, n: (F.col(k) + 0.5) / F.lit(n + 1.0)
    odds = F.log(rate("pos", pos)) - F.log(rate("neg", neg))
    sd = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.select("term", odds.alias("odds"), (odds / sd).alias("z"), "pos", "neg").orderBy(F.abs(odds / sd).desc(), "term").limit(TERMS).collect()
    names = list(dict.fromkeys([*(r.term for r in best), *INSULTS]))
    told = sample.select("text", "toxic").repartition(8).select("text", "toxic")
    rows, patterns, toxic = [], [], []
    for r in told.mapInArrow(_describe(names), "terms array<int>, patterns array<boolean>, toxic int").toLocalIterator():
        rows.append(list(r[0]))
        patterns.append(list(r[1]))
        toxic.append(r[2])
    # Clear lexicon voters: nearly always with the label, and surely not by chance.
    mined = [i for i, r in enumerate(best) if r.z >= SURE and r.pos >= PRECISION * (r.pos + r.neg)][:VOTERS]
    lexicon = sorted({*mined, *(names.index(w) for w in INSULTS)})
    place = {t: k for k, t in enumerate(lexicon)}
    votes = np.zeros((len(rows), len(lexicon) + len(PATTERNS) + 1), np.uint8)
    for i, r in enumerate(rows):
        votes[i, [place[t] for t in r if t in place]] = 1
    votes[:, len(lexicon) : -1] = np.array(patterns, np.uint8)
    fired = votes[:, : len(lexicon)].any(1)
    votes[:, -1] = ~fired
    model = LabelModel().fit(votes, np.where(fired, 0.9, 0.02))
    weights, constant = logistic(rows, model.posterior(votes), len(names))
    slope, shift = calibration(np.array([weights[r].sum() + constant for r in rows]), np.array(toxic))
    weights, constant = slope * weights, slope * constant + shift
    voters = [*(names[i] for i in lexicon), *(p[0] for p in PATTERNS), "silence"]
    return {"names": names, "weights": weights.tolist(), "constant": constant, "voters": list(zip(voters, model.fires.T.tolist(), model.share.tolist()))}


def _terms(names: tuple[str, ...]) -> Terms:
    return held(("terms", names), lambda: Terms(list(names)))


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    names, weights, constant = tuple(model["names"]), np.array(model["weights"]), model["constant"]

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        known = _terms(names)
        logit = np.array([constant + sum(weights[i] for i in sorted(known.of(t.as_py()))) for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    add = lambda d: d.withColumn("score", scored(F.col("text"))).withColumns({"held_out": held_out(F.col("doc_id")), "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
    return apart(docs, add, {"doc_id": id, "text": text}, ("score", "held_out", "predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents, learned from ``labels``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", *ADDED)
