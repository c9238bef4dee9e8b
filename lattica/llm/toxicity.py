"""Toxicity by weak supervision.

Voters look at a text: one for each word of a lexicon as a word, one for it inside a longer word, some
patterns, and words and beginnings of words mined from labelled rows. A voter fires or abstains. A
generative label model (two latent classes, every voter with its own rate of firing in each, and the
rate at which all abstain) is estimated by expectation maximisation. Labels that may be learnt from
choose the mined words, set the share of the classes and start the estimate; from then on it follows
the votes alone. Voters that still fire together within a class count as correlated, and each one's
evidence is divided by the size of its correlated company. A linear classifier over the voters is then
fitted to the posteriors.

Fitted on at most ``PER_CLASS`` labelled rows of either label and ``SAMPLE_CHARS`` characters of
each (a bound for fitting only; every text is scored whole).

Defined cases: null counts as the empty text. Without labels of both kinds the lexicon alone votes.
Repeated rows keep one row each; conflicting labels are all used. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id_col, labelled_sample, table

PER_CLASS = 2500
SAMPLE_CHARS = 12_000
MINED = 300
BEGINNINGS = (3, 4, 5, 6, 7)
#: The query's contract: predicted is 1 from this score.
ACCEPT = 0.7

#: Correlation within a class from which voters count as company.
COMPANY = 0.5
#: Weight of a lexicon word, and bias, before anything is learnt.
UNLEARNT = 4.0, -2.0

#: Insults that serve as voters.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "clown", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "retard", "filth", "vermin", "bitch", "asshole", "shithead", "fuck", "shut up", "kill yourself", "go to hell", "hate you")

WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{3,}")
_THREAT = re.compile(r"\b(?:i will|i'll|we will|gonna) (?:kill|hurt|find|destroy) you\b")


def pieces(text: str) -> set[str]:
    """Words of a lower-cased text, and their beginnings (with a hyphen)."""
    words = set(WORD.findall(text))
    return words | {w[:n] + "-" for n in BEGINNINGS for w in words if len(w) > n}


def features(text: str | None, mined: frozenset[str]) -> set[str]:
    """Names of the voters that fire and of the mined words that occur."""
    low = (text or "").lower()
    words = pieces(low)
    out = {"w:" + w for w in words & mined}
    for term in LEXICON:
        if term in low:
            out.add("in:" + term)
            if term in words or " " in term:
                out.add("is:" + term)
    if _SHOUT.search(low):
        out.add("p:shout")
    if _THREAT.search(low):
        out.add("p:threat")
    return out


def label_model(votes: np.ndarray, y: np.ndarray, share: float, rounds: int = 100) -> np.ndarray:
    """Posterior of class 1 for each row of the 0/1 matrix of votes. ``y``: labels, which start the
    estimate; ``share``: of class 1."""
    n = len(votes)
    post = np.clip(y.astype(float), 0.05, 0.95)
    some = votes.any(1)
    prior = np.log(share / (1 - share))
    rate = lambda fired, weight: np.clip((fired + 0.1) / (weight + 1), 1e-4, 1 - 1e-4)
    for _ in range(rounds):
        w1, w0 = post.sum(), n - post.sum()
        p1, p0 = rate(votes.T @ post, w1), rate(votes.T @ (1 - post), w0)
        silent = np.log(rate(post @ ~some, w1) / rate((1 - post) @ ~some, w0))
        # what is left of the votes after the class explains them
        rest = votes - (np.outer(post, p1) + np.outer(1 - post, p0))
        sd = np.sqrt((rest**2).mean(0)) + 1e-9
        corr = np.abs(rest.T @ rest) / n / np.outer(sd, sd)
        company = np.maximum(1.0, np.where(corr > COMPANY, corr, 0).sum(0))
        logit = prior + np.where(some, votes @ (np.log(p1 / p0) / company), silent)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-5:
            return new
        post = new
    return post


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    mined: frozenset[str]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get = self.weights.get
        z = np.array([self.bias + sum(get(f, 0.0) for f in features(t, self.mined)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def mine(rows: list[tuple[object, str, int]]) -> frozenset[str]:
    """Words far more often in texts of label 1: a bounded number, each in 1 % of them at least."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = Counter(y for _, _, y in rows)
    for _, text, y in rows:
        seen[y].update(pieces(text.lower()))
    least = max(5, 0.01 * n[1])
    lift = {w: (c / n[1]) / ((seen[0][w] + 0.5) / (n[0] + 1)) for w, c in seen[1].items() if c >= least and len(w) > 2}
    return frozenset(sorted((w for w, x in lift.items() if x >= 20), key=lambda w: (-lift[w], w))[:MINED])


def linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.005, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    lam = np.full(z.shape[1], ridge)
    lam[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (target - p)) - lam * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(lam)
        step = np.clip(np.linalg.solve(h, g), -4, 4)
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return b[:-1], float(b[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels of rows whose crc32 of the id is not 1 modulo 3."""
    rows, share = labelled_sample(docs, labels, "toxic", crc_of_id_col() % 3 != 1, PER_CLASS, SAMPLE_CHARS)
    share = min(max(share, 0.01), 0.99)
    if {y for _, _, y in rows} != {0, 1}:
        return Model({"is:" + t: UNLEARNT[0] for t in LEXICON}, UNLEARNT[1], frozenset())
    mined = mine(rows)
    found = [features(t, mined) for _, t, _ in rows]
    names = sorted(set().union(*found) | {"in:" + t for t in LEXICON} | {"is:" + t for t in LEXICON})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, fs in enumerate(found):
        x[i, [at[f] for f in fs]] = 1
    y = np.array([r[2] for r in rows])
    sampled = y.mean()
    post = label_model(x, y, float(sampled))
    weight = np.where(y == 1, share / sampled, (1 - share) / (1 - sampled))
    w, bias = linear(x, post, weight)
    weights = dict(zip(names, w.tolist(), strict=True))
    # a lexicon word that the sample doesn't have votes like the average of those it has, as a word only
    seen = [t for t in LEXICON if x[:, at["is:" + t]].any()]
    usual = float(np.mean([weights["is:" + t] + weights["in:" + t] for t in seen])) if seen else UNLEARNT[0] - UNLEARNT[1] - bias
    for t in LEXICON:
        if not x[:, at["in:" + t]].any():
            weights["is:" + t] = usual
    return Model({f: v for f, v in weights.items() if v}, bias, mined)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= ACCEPT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (crc_of_id_col() % 3 == 1).alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
