"""Language ID: a linear-chain conditional random field labels the words of a text.

Words are runs of letters.  Features of a word are its affixes, character n-grams and the
languages whose lexicon holds it, hashed.  Label transitions are learned too, so a
passage in another language keeps its own label among its neighbours.  Forward-backward
gives each word's probabilities; a text's are their mean over its words, and its language
is the likeliest (ties: the first by name).

The fit uses a bounded sample of labelled texts, ``per_language`` different ones of each
language (all, if it has fewer), chosen by a hash of id and text.  Sampled texts are used whole,
in pieces; training sequences join pieces of several texts, so switches are seen.  Prediction
runs over whole texts, however long.

* Null texts and texts without a letter: ``und``, score 0.  So is everything if nothing
  could be learned.  Null languages are not learned from.
* Repeated rows get equal labels; result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.llm.common import SLICE_BYTES, U, ends_of, mixed, over, row_and, slices, whole_rows, window_hashes, with_columns

#: Hashed features, and lengths of n-grams.
HASHES, GRAMS = 1 << 18, (2, 3, 4)
#: Numbers in the step matrices of words that are worked out at once; more go by vectors.
MATRICES = 1 << 25
#: Words of a training piece, and pieces in a training sequence.
PIECE, PIECES = 25, 4
RESULTS = ["lang_pred", "score"]
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    words = _WORD.findall(text.decode().lower())
    # The pattern also takes number signs such as fractions: alone they are no text.
    return words if any(c.isalpha() for w in words for c in w) else []


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the words they belong to.

    With marks at both ends, n-grams that hold a mark are affixes; so are the others of
    their length not."""
    marked = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(U)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    found, of = [], []
    for size in GRAMS:
        hashes = window_hashes(marked, size, 0x9E3779B97F4A7C15 + 2 * size)
        inside = owner[: len(hashes)] == owner[size - 1 :]
        found.append(hashes[inside])
        of.append(owner[: len(hashes)][inside])
    known = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    found.append(mixed(known[known > 0].astype(U)))
    of.append(np.flatnonzero(known))
    return (np.concatenate(found) % U(HASHES)).astype(np.int64), np.concatenate(of)


@dataclass
class Field:
    """Languages, lexicon, and parameters: feature weights, transitions, start scores."""

    languages: list[str]
    lexicon: dict[str, int]
    weight: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def sums(values: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by key."""
    return np.stack([np.bincount(key, values[:, k], size) for k in range(values.shape[1])], axis=1)


def emissions(words: list[str], field: Field) -> np.ndarray:
    """Label scores of words; each distinct one is worked out once."""
    code, distinct = pd.factorize(np.array(words, object))
    feature, owner = features(distinct.tolist(), field.lexicon)
    return sums(field.weight[feature], owner, len(distinct))[code]


def marginals(emission: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Label probabilities of words of many texts on end; ``first`` marks beginnings."""
    n, labels = emission.shape
    if n * labels * labels <= MATRICES:
        return matrix_marginals(emission, first, field)
    forward, backward, _, _ = messages(emission, first, field)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def matrix_marginals(emission: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Forward-backward by one matrix a word.

    The chain is laid out in rows of about its root's length.  Products of the step matrices
    give what a whole row does to a message, so all rows run forward and backward at once;
    the step into a text's first word forgets what came before."""
    n, labels = emission.shape
    width = max(1, math.isqrt(n))
    rows = -(-n // width)
    score = np.zeros((rows * width, labels))
    score[:n] = emission - emission.max(axis=1, keepdims=True)
    step = np.exp(field.transition)[None] * np.exp(score)[:, None, :]
    begins = np.ones(rows * width, bool)
    begins[:n] = first
    step[begins] = (np.exp(field.start) * np.exp(score[begins]))[:, None, :]
    step = step.reshape(rows, width, labels, labels)

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)

    through = step[:, 0]
    for c in range(1, width):
        through = scaled(through @ step[:, c])
    into, out = np.ones((rows, 1, labels)), np.ones((rows, labels, 1))
    for r in range(1, rows):
        into[r] = scaled(into[r - 1 : r] @ through[r - 1])[0]
        out[-1 - r] = scaled((through[-r] @ out[-r])[None])[0]
    forward = np.empty((rows, width, labels))
    for c in range(width):
        into = scaled(into @ step[:, c])
        forward[:, c] = into[:, 0]
    both = forward
    for c in range(width - 1, -1, -1):
        both[:, c] *= out[:, :, 0]
        out = scaled(step[:, c] @ out)
    both = both.reshape(-1, labels)[:n]
    return both / both.sum(axis=1, keepdims=True)


def training_pieces(rows: DataFrame) -> list[tuple[str, list[str]]]:
    """Language and words of the pieces, of PIECE words, of a bounded number of texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            pieces = [[w[k : k + PIECE] for k in range(0, len(w), PIECE)] for w in map(words_of, texts)]
            kind = pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, kind)], names=["lang", "pieces"])

    found = rows.select("lang", "text").mapInArrow(cut, "lang string, pieces array<array<string>>")
    return sorted((r["lang"], list(piece)) for r in found.toLocalIterator() for piece in r["pieces"])


def fit(pieces: list[tuple[str, list[str]]], rounds: int = 60, seed: int = 11) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of sequences of pieces."""
    languages = sorted({lang for lang, _ in pieces})
    number = {lang: k for k, lang in enumerate(languages)}
    seen: dict[str, Counter] = {}
    for lang, words in pieces:
        for word in words:
            seen.setdefault(word, Counter())[number[lang]] += 1
    # A word that occurs in several pieces, by the set of languages that use it.
    sets: dict[tuple[int, ...], int] = {}
    lexicon = {
        word: sets.setdefault(tuple(sorted(k for k, c in by.items() if c * 10 >= sum(by.values()))), len(sets) + 1)
        for word, by in seen.items()
        if sum(by.values()) >= 5
    }
    random = np.random.default_rng(seed)
    order = random.permutation(len(pieces))
    words = [w for k in order for w in pieces[k][1]]
    gold = np.array([number[pieces[k][0]] for k in order for _ in pieces[k][1]])
    first = np.zeros(len(words), bool)
    lengths = np.array([len(pieces[k][1]) for k in order])
    first[ends_of(lengths)[0][::PIECES]] = True

    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(words))}
    feature, owner = features(list(vocabulary), lexicon)
    used, feature = np.unique(feature, return_inverse=True)
    at = np.array([vocabulary[w] for w in words])
    labels = len(languages)
    one_hot = np.eye(labels)[gold]
    theta = [np.zeros((len(used), labels)), np.eye(labels), np.zeros(labels)]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    inner = np.flatnonzero(~first)

    for t in range(1, rounds + 1):
        field = Field(languages, lexicon, theta[0], theta[1], theta[2])
        emission = sums(theta[0][feature], owner, len(vocabulary))[at]
        p = marginals(emission, first, field)
        # Pairs: neighbours' joint probabilities from the marginals and the step between.
        pair = pair_marginals(emission, first, field)
        difference = one_hot - p
        by_word = sums(difference, at, len(vocabulary))
        gradient = [
            sums(by_word[owner], feature, len(used)) - 0.1 * theta[0],
            one_hot[inner - 1].T @ one_hot[inner] - pair - 0.1 * theta[1],
            difference[first].sum(axis=0) - 0.1 * theta[2],
        ]
        for k, g in enumerate(gradient):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta[k] = theta[k] + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros((HASHES, labels), np.float32)
    weight[used] = theta[0]
    return Field(languages, lexicon, weight, theta[1], theta[2])


def messages(emission: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, ...]:
    """Forward and backward vectors of all words, scaled word by word, all texts at once; and
    the exponentials of emissions and transitions."""
    n, labels = emission.shape
    score = np.exp(emission - emission.max(axis=1, keepdims=True))
    step, start = np.exp(field.transition), np.exp(field.start)
    begin = np.flatnonzero(first)
    lengths = np.diff(np.append(begin, n))
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    # Texts with more than c words come first.
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
    forward, backward = np.empty((n, labels)), np.ones((n, labels))
    for c, m in enumerate(active):
        at = begin[:m] + c
        a = score[at] * (start if c == 0 else forward[at - 1] @ step)
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for c in range(len(active) - 1, 0, -1):
        at = begin[: active[c]] + c
        b = (score[at] * backward[at]) @ step.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    return forward, backward, score, step


def pair_marginals(emission: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Expected number of each transition, summed over all neighbours inside sequences."""
    forward, backward, score, step = messages(emission, first, field)
    labels = emission.shape[1]
    inner = np.flatnonzero(~first)
    total = np.zeros((labels, labels))
    for at in np.array_split(inner, max(1, len(inner) * labels * labels // MATRICES)):
        joint = forward[at - 1][:, :, None] * step[None] * (score[at] * backward[at])[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return total


def learn(docs: DataFrame, train: Column, per_language: int = 80, id: str = "doc_id", seed: int = 11) -> Field | None:
    """A field from ``per_language`` different texts of each language (None: nothing to learn)."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = known.select("lang", "text", F.xxhash64(F.lit(seed), id, "text").alias("h"))
    # Copies share a hash, so shares are of different hashes; four times what is wanted, as
    # numbers are estimates and draws.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * per_language / max(1, r["n"])))))
    chance = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= per_language)
    return fit(training_pieces(sample), seed=seed)


def predict(docs: DataFrame, field: Field | None, sure: str | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, its mean probability over the text's words.

    ``sure``: a column for the mean probability of each word's own likeliest language."""
    rows = whole_rows(docs)
    results = RESULTS + [sure] * (sure is not None)
    if field is None:
        none = [F.lit(0.0).alias(n) for n in results[1:]]
        return over(rows.select("row", F.lit("und").alias("lang_pred"), *none), results)
    model = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        # Slices of texts whose step matrices are bounded, but for a text that is longer alone.
        size = 4 * SLICE_BYTES // max(16, len(own.languages) ** 2)
        names = np.array([*own.languages, "und"], object)
        for batch, texts in slices(batches, "row.text", size):
            words = [words_of(t) for t in texts]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            best, score = np.full(len(words), len(own.languages)), np.zeros(len(words))
            each = np.zeros(len(words))
            if lengths.sum():
                has = np.flatnonzero(lengths)
                begin = ends_of(lengths[has])[0]
                first = np.zeros(int(lengths.sum()), bool)
                first[begin] = True
                p = marginals(emissions([w for x in words for w in x], own), first, own)
                mean = np.add.reduceat(p, begin, axis=0) / lengths[has][:, None]
                best[has], score[has] = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
                if sure is not None:
                    each[has] = np.minimum(np.add.reduceat(p.max(axis=1), begin) / lengths[has], 1.0)
            more = {} if sure is None else {sure: pa.array(each)}
            yield with_columns(batch, "", lang_pred=pa.array(names[best], pa.string()), score=pa.array(score), **more)

    schema = ", ".join(["lang_pred string", *(f"`{n}` double" for n in results[1:])])
    return over(rows.mapInArrow(label, row_and(rows, schema)), results)
