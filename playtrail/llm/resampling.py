"""Target-distribution importance resampling with hashed word n-grams.

A document's n-grams of 1 to 3 words fall into buckets by crc32.  A bucket's gain is the log
ratio of its share in the target texts to that in the corpus; a document's weight is the sum of
its gains, and Gumbel noise on the weights makes the highest scores a draw without replacement.

n-grams are never built.  Words are put one space apart and scanned once, keeping the running
CRC after every word.  CRCs are linear over GF(2): the CRC of any stretch is the running CRC at
its end, plus the one before its begin shifted by the length of the stretch, which cancels
all that came before.  Shifts by a length are table look-ups, for whole arrays of n-grams at once.

The corpus is read twice, once for the bucket counts and once for the weights: reading again is
cheaper than writing a CRC for each word.  Between the two, 10,000 sums are all that is sent to
the driver.  Scored rows are stored; rows that can be drawn are sorted by ranges and ranked by
their range's offset, so no task sees more than a range.

Null texts have no words: no features, weight 0.  Null ids draw their noise as the empty text
and come first among ties; rows equal in score and id are ranked in their stored order.
An empty table gives an empty result, an empty target a gain by the corpus' counts alone.
Result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import SLICE_BYTES, WORDS, ends_of, over, row_and, slices, stored, sums_by_run

LONGEST = 3
BUCKETS = 10_000
#: Lengths below have a shift table of their own, longer ones add powers of two.
DIRECT = 128
RESULTS = ["n_features", "weight", "score", "rank"]
_WORD = re.compile(rb" [^ ]+")
_U32 = np.uint32


@cache
def _byte_table() -> np.ndarray:
    """What a byte does to a CRC: the polynomial's remainders, by its reflected form."""
    table = np.arange(256, dtype=_U32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ _U32(0xEDB88320), table >> 1)
    return table


def _looked_up(tables: np.ndarray, crcs: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """The linear map given by its values for each of the four bytes; ``first``: where each
    element's map begins in ``tables``."""
    out = tables[first + (crcs & _U32(255))]
    for k in (1, 2, 3):
        out = out ^ tables[first + 256 * k + ((crcs >> _U32(8 * k)) & _U32(255))]
    return out


@cache
def _direct_tables() -> np.ndarray:
    """Shifts by 0 to DIRECT bytes, each as four tables of a byte."""
    step = (np.arange(256, dtype=_U32)[None, :] << (8 * np.arange(4, dtype=_U32))[:, None]).ravel()
    rows = []
    for _ in range(DIRECT + 1):
        rows.append(step)
        step = _byte_table()[step & 255] ^ (step >> 8)
    return np.concatenate(rows)


@cache
def _power_table(k: int) -> np.ndarray:
    """Shift by DIRECT * 2**k bytes."""
    if k == 0:
        return _direct_tables()[DIRECT * 1024 :]
    half = _power_table(k - 1)
    return _looked_up(half, half)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved on over so many bytes."""
    out = _looked_up(_direct_tables(), crcs, (lengths % DIRECT) * 1024)
    more, k = lengths // DIRECT, 0
    while more.any():
        odd = np.flatnonzero(more & 1)
        out[odd] = _looked_up(_power_table(k), out[odd])
        more, k = more >> 1, k + 1
    return out


class Running:
    """Running CRCs over a stretch of words, each with one space before it."""

    def __init__(self, spaced: bytes) -> None:
        crc = 0
        words = _WORD.findall(spaced)
        after = [crc := crc32(word, crc) for word in words]
        self.size = len(words)
        self.after = np.array(after, _U32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes + 1
        # One more byte, the space, to what was before a word; CRCs are kept inverted.
        last = ~np.concatenate([np.zeros(1, _U32), self.after[:-1]])
        self.before = ~(_byte_table()[(last ^ 32) & 255] ^ (last >> 8))[: self.size]

    def grams(self, n: int) -> np.ndarray:
        """CRCs of each word with the n - 1 words that follow it."""
        last = slice(n - 1, None)
        first = slice(0, max(0, self.size - n + 1))
        return self.after[last] ^ shifted(self.before[first], self.end[last] - self.begin[first])


def _stretches(texts: list[bytes], size: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """First text, words of it that belong to the stretch before, spaced words, and the words
    of each text.  A text of more than ``size`` bytes is cut; its pieces share LONGEST - 1 words."""
    together: list[list[bytes]] = []
    begin = held = 0
    for k, text in enumerate(texts):
        words = text.translate(WORDS).split()
        if len(text) <= size and held + len(text) <= size:
            together.append(words)
            held += len(text)
            continue
        if together:
            yield _stretch(begin, 0, together)
        step = max(1, len(words) * size // max(1, len(text)))
        for at in range(0, max(1, len(words)), step):
            context = max(0, at - LONGEST + 1)
            yield _stretch(k, at - context, [words[context : at + step]])
        together, begin, held = [], k + 1, 0
    if together:
        yield _stretch(begin, 0, together)


def _stretch(begin: int, context: int, words: list[list[bytes]]) -> tuple[int, int, bytes, np.ndarray]:
    spaced = b"".join(b" " + b" ".join(w) for w in words if w)
    return begin, context, spaced, np.fromiter(map(len, words), np.int64, len(words))


def features(texts: list[bytes], buckets: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, list]]:
    """First text of a stretch, its texts' words, and for each n the bucket of the n-gram that
    ends at a word, or ``buckets`` where there is none (or the stretch before had it)."""
    for first, context, spaced, lengths in _stretches(texts, size):
        run = Running(spaced)
        begin, _ = ends_of(lengths)
        place = np.arange(run.size) - np.repeat(begin, lengths)
        found = []
        for n in range(1, LONGEST + 1):
            ends = np.full(run.size, buckets, np.int64)
            ends[n - 1 :] = run.grams(n) % _U32(buckets)
            ends[place < max(n - 1, context)] = buckets
            found.append(ends)
        new = lengths.copy()
        new[:1] -= context
        yield first, lengths, [new, *found]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: one row a bucket from each task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for _, texts in slices(batches, "text"):
            for _, _, (_, *found) in features(texts, buckets):
                for ends in found:
                    total += np.bincount(ends, minlength=buckets + 1)
        held = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long")
    summed = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"]] = summed["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the buckets' smoothed shares."""
    buckets = len(corpus)
    whole, wanted = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(corpus, target)], np.int64
    )


def weighted(docs: DataFrame, gains: np.ndarray, text: str) -> DataFrame:
    """``row`` with n_words, n_features and weight; ``text`` names the column of the texts."""
    buckets = len(gains)
    padded = np.append(gains, 0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            words, grams, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, lengths, (new, *found) in features(texts, buckets):
                these = slice(first, first + len(lengths))
                words[these] += new
                for ends in found:
                    grams[these] += sums_by_run((ends < buckets).astype(np.int64), lengths)
                    weight[these] += sums_by_run(padded[ends], lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *map(pa.array, (words, grams, weight))], names=["row", "n_words", "n_features", "weight"]
            )

    return docs.mapInArrow(weigh, row_and(docs, "n_words long, n_features long, weight long"))


def noise(seed: int, key: Column) -> Column:
    """floor(1000 * Gumbel noise) by a hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform)))


def draw(scored: DataFrame, eligible: Column, share: int) -> DataFrame:
    """Adds ``rank`` to the ``share`` percent of the eligible rows with the highest scores.

    ``scored`` has row (with doc_id), score and ``at``, a number of its own for each row."""
    candidates, id_of = scored.where(eligible), F.col("row.doc_id")
    n = candidates.count()
    wanted = share * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.withColumn("rank", none)
    # A bound a little below the draw's lowest score; the sketch's size is fixed.
    near = candidates.agg(F.percentile_approx("score", max(0.0, 1 - wanted / n - 0.001), 10_000)).first()[0]
    if candidates.where(F.col("score") >= near).count() < wanted:
        near = candidates.agg(F.min("score")).first()[0]
    order = [F.col("score").desc(), id_of.asc_nulls_first(), F.col("at")]
    top = candidates.where(F.col("score") >= near).repartitionByRange(*order).sortWithinPartitions(*order)
    # The range in the high bits, the place in it in the low ones; stored, so both stay.
    placed = stored(top.withColumn("place", F.monotonically_increasing_id()), "resampling-top")
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    offsets = scored.sparkSession.createDataFrame(
        [(r["part"], b) for r, b in zip(sizes, before)], "part long, before long"
    )
    rank = F.col("before") + within + 1
    ranked = placed.join(F.broadcast(offsets), part == F.col("part"))  # one row a range
    drawn = ranked.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.where(~eligible | (F.col("score") < near)).withColumn("rank", none)
    return drawn.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of the documents (default: all) with n_features, weight, score and
    rank, from 1 for the highest score; null where not drawn.  Texts of fewer than
    ``least_words`` words are scored but never drawn."""
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    kept = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    held = "text" in kept
    found = weighted(docs.select(row) if held else docs.select(row, "text"), gains, "row.text" if held else "text")
    score = F.col("weight") + noise(seed, F.col("row.doc_id"))
    scored = stored(found.withColumns({"score": score, "at": F.monotonically_increasing_id()}), "resampling-scores")
    return over(draw(scored, F.col("n_words") >= least_words, share), RESULTS)
