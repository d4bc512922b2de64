"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words (A-Z lowered, split at ASCII non-alphanumerics) and
their beginnings, hashed.  Its logit is w0 + sum of w_i + sum over pairs of <v_i, v_j>: the
factors v let two terms together mean more, or less, than each alone.

Only the fit looks at a sample: at most ``sample`` labelled texts, those with the smallest
hash of their id.  Terms are kept by their chi-square with the label.  Scoring covers whole
texts; a text without known term, or without words, gets the score of w0 alone.

* Labels that are null are not learned from; of several labels of a text the largest counts.
* Without labelled rows every score is 0.5.
* Repeated rows get equal scores; result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import WORDS, over, row_and, slices, whole_rows, with_columns

#: Hashed terms; lengths of beginnings that are terms too; words a task remembers at once.
HASHES, BEGINNINGS, REMEMBERED = 1 << 24, (4, 5, 6), 400_000


@dataclass
class Machine:
    """Parameters of the chosen terms: ``terms`` holds their hashes, sorted."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bias: float = 0.0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def score(self, active: list[int]) -> float:
        v = self.factor[active]
        logit = self.bias + self.weight[active].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))


def hashed_terms(word: bytes) -> list[int]:
    from xxhash import xxh64_intdigest

    return [
        xxh64_intdigest(word) % HASHES,
        *(xxh64_intdigest(b"%d:%s" % (n, word[:n])) % HASHES for n in BEGINNINGS if len(word) >= n),
    ]


class Known(dict):
    """Words to the numbers of their chosen terms, worked out when first met."""

    def __init__(self, terms: np.ndarray) -> None:
        super().__init__()
        self.number = {t: k for k, t in enumerate(terms.tolist())}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.number[t] for t in hashed_terms(word) if t in self.number)
        return found


def training_terms(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Label and distinct hashed terms of a bounded number of rows ``toxic, text``."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            terms = [
                np.unique(np.array([t for w in set(x.translate(WORDS).split()) for t in hashed_terms(w)], np.uint32))
                for x in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.tobytes() for t in terms], pa.binary())], names=["toxic", "terms"]
            )

    found = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(hash_texts, "toxic int, terms binary")
    # Copies would make all their terms look like signs of their label: each set counts once.
    return [(y, np.frombuffer(t, np.uint32)) for y, t in sorted({(r["toxic"], bytes(r["terms"])) for r in found.collect()})]


def choose(terms: np.ndarray, owner: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """The terms with the largest chi-square, of those in ten texts or more."""
    own, back, count = np.unique(terms, return_inverse=True, return_counts=True)
    n, positive = len(label), label.sum()
    with_label = np.bincount(back, label[owner], len(own))
    expected = count * positive / n
    spread = expected * (1 - positive / n) * (1 - count / n) + 1e-9
    chi = np.where(count >= 10, (with_label - expected) ** 2 / spread, 0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(own[best[chi[best] > 30]])


def fit(rows: list[tuple[int, np.ndarray]], most: int, factors: int, epochs: int, seed: int) -> Machine:
    """Adam on the log loss, in batches; each time a text is seen half of its terms are left
    out, so that no term relies on others always being there."""
    if not rows:
        return Machine()
    label = np.array([y for y, _ in rows], np.float64)
    lengths = np.array([len(t) for _, t in rows])
    terms, owner = np.concatenate([t for _, t in rows]), np.repeat(np.arange(len(rows)), lengths)
    own = choose(terms, owner, label, most)
    at = np.minimum(np.searchsorted(own, terms), max(0, len(own) - 1))
    keep = own[at] == terms if len(own) else np.zeros(len(terms), bool)
    at, owner = at[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    random = np.random.default_rng(seed)
    rate = min(max(label.mean(), 1e-3), 1 - 1e-3)
    theta = [np.array([math.log(rate / (1 - rate))]), np.zeros(len(own)), random.normal(0, 0.02, (len(own), factors))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 256)):
            size = starts[batch + 1] - starts[batch]
            place = np.repeat(starts[batch], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text = np.repeat(np.arange(len(batch)), size)
            stays = random.random(len(place)) < 0.5
            i, text = at[place[stays]], text[stays]
            v = theta[2][i]
            total = np.stack([np.bincount(text, v[:, f], len(batch)) for f in range(factors)], axis=1)
            square = np.bincount(text, (v * v).sum(axis=1), len(batch))
            logit = theta[0] + np.bincount(text, theta[1][i], len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[batch]) / len(batch)
            by_term = error[text]
            slope = by_term[:, None] * (total[text] - v)
            gradient = [
                np.array([error.sum()]),
                np.bincount(i, by_term, len(own)) + 1e-6 * theta[1],
                np.stack([np.bincount(i, slope[:, f], len(own)) for f in range(factors)], axis=1) + 1e-4 * theta[2],
            ]
            step += 1
            for k, g in enumerate(gradient):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                theta[k] = theta[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(own, float(theta[0][0]), theta[1], theta[2])


def learn(
    docs: DataFrame, labels: DataFrame, train: Column, sample: int = 6_000, terms: int = 8192, factors: int = 4,
    epochs: int = 12, seed: int = 5,
) -> Machine:
    """A machine from at most ``sample`` labelled ids of ``train`` (a condition on doc_id), one
    text each: of an id with several, the last by order of texts."""
    known = labels.where(F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # One text an id, however many rows it has: the greatest, nulls last.
    rows = joined.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return fit(training_terms(rows), terms, factors, epochs, seed)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds ``score``, the probability of the label 1."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        known = Known(own.terms)
        for batch, texts in slices(batches, "row.text"):
            scores = []
            for text in texts:
                active = set().union(*filter(None, map(known.__getitem__, text.translate(WORDS).split())))
                scores.append(own.score(sorted(active)))
            yield with_columns(batch, "", score=pa.array(scores, pa.float64()))

    rows = whole_rows(docs)
    return over(rows.mapInArrow(score, row_and(rows, "score double")), ["score"])
