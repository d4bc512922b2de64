"""Language-model scores by deleted interpolation of word pairs.

P(w | u) = a f(w | u) + b f(w) + c / (V + 1), where f are maximum-likelihood estimates from
the training texts and the weights a, b, c depend on how often the context u was seen
(buckets by powers of two).  The weights are learned by expectation-maximisation on counts
of texts that the estimates were not made from; scoring uses estimates from all of both.

All counts cover the whole corpus: each chunk of documents sends its distinct words and
word pairs to the buckets that add them up and gets the sums back (``packed``); all 64 bits
of their hashes tell them apart.  What EM
needs from the held-out texts are counts in cells of (bucket, f(w|u), f(w)) on a fine
logarithmic grid, so their number has a bound that doesn't grow with the corpus.

* Each text ends with one end token, so a null or empty text has one token; its context at
  the start of a text is the end token.
* Rows are scored alike whether repeated or not; repeated training rows count twice.
* Without training tokens every estimate is 0 and the uniform part decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import LOWER, U, ends_of, free_shuffles, hashed_words, lean, mixed, stored, text_bytes
from playtrail.llm.packed import SENT, chunks_for, corpus_counts, counts_for, distinct, in_chunks, pack, sent, unpack

#: The end token's hash: no word has it but by chance of 1 in 2^64.
END = U(0x9AE16A3B2F90404F)
#: Contexts seen 2^(k-1) to 2^k - 1 times are in bucket k; steps of the grid for a factor of 2.
CONTEXTS, GRID = 48, 8
_COUNTED = (
    "doc_id long, part int, n_tokens long, n_known long, base_sum double, types double, "
    "words binary, pairs binary, main_words binary, main_pairs binary"
)
#: Text bytes of a chunk: larger ones send fewer pairs that others send too.
CHUNK_BYTES = 12 << 20
#: Texts that a step inside a task handles at once.
TEXTS = 1000


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts on end, and each text's number of tokens."""
    words, lengths = hashed_words((t or "").encode().translate(LOWER) for t in texts)
    lengths = lengths + 1
    flat = np.full(len(words) + len(lengths), END, U)
    is_word = np.ones(len(flat), bool)
    is_word[np.cumsum(lengths) - 1] = False
    flat[is_word] = words
    return flat, lengths


def pair_hashes(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it (at a text's start: the end token)."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[:1] = END
    before[ends_of(lengths)[0]] = END
    return mixed(before * U(0x9E3779B97F4A7C15) + flat * U(0xC2B2AE3D27D4EB4F))


def counted(docs: DataFrame) -> DataFrame:
    """For each row of ``doc_id, text, part`` (0: estimates, 1: held out for the weights,
    2: test), of its tokens: how many occur in training texts, the sum of log10(count + 1),
    of training rows the sum of 1 / count (which adds up to the number of types), and packed
    the counts of all words and pairs in parts 0 and 1, for part 1 also in part 0 alone."""
    n = chunks_for(text_bytes(docs), CHUNK_BYTES)
    chunked = in_chunks(docs, n)

    def keys(chunk: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        flat, lengths = word_hashes(chunk.column("text").to_pylist())
        part = np.repeat(chunk.column("part").to_numpy(), lengths)
        return [flat, pair_hashes(flat, lengths)], part, lengths

    def send(chunk: pa.Table) -> pa.Table:
        hashes, part, _ = keys(chunk)
        number = chunk.column("chunk")[0].as_py()
        return pa.concat_tables(
            sent(number, *distinct(h, part == 0, part == 1), n, None, kind) for kind, h in enumerate(hashes)
        )

    # The keys are the most that lies on disks.  With the answers stored they can go before the
    # texts meet the answers, at the price of dealing the texts to their chunks a second time.
    by_chunk = chunked.groupBy("chunk").applyInArrow(lean(send), SENT)
    counts = stored(corpus_counts(by_chunk, sums=2, steps=True), "lm-answers", compression="zstd")
    free_shuffles(docs.sparkSession)

    def answer(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, part, lengths = keys(chunk)
        begin, end = ends_of(lengths)
        found = []
        for kind in (0, 1):
            own, counts = distinct(hashes[kind], part == 0, part == 1)
            totals, _ = counts_for(own, counts, answers, n, kind, steps=True)
            found.append(totals[:, np.searchsorted(own, hashes[kind])])
        (main_words, held_words), (main_pairs, held_pairs) = found
        words, pairs = main_words + held_words, main_pairs + held_pairs
        part_of = chunk.column("part").to_numpy()

        def packed(values: np.ndarray, rows: np.ndarray) -> pa.Array:
            return pa.array([pack(values[a:b]) if r else None for a, b, r in zip(begin, end, rows)], pa.binary())

        every, held = np.ones(len(begin), bool), part_of == 1
        return pa.table(
            {
                "doc_id": chunk.column("doc_id"),
                "part": chunk.column("part"),
                "n_tokens": pa.array(lengths.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((words > 0).astype(np.int64), begin)),
                "base_sum": pa.array(np.add.reduceat(np.log10(words + 1.0), begin)),
                "types": pa.array(np.add.reduceat(np.where(part < 2, 1 / np.maximum(words, 1), 0), begin)),
                "words": packed(words, every),
                "pairs": packed(pairs, every),
                "main_words": packed(main_words, held),
                "main_pairs": packed(main_pairs, held),
            }
        )

    answers = chunked.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lean(answer), _COUNTED)
    return stored(answers, "lm-counts", compression="zstd")


class Counts:
    """Counts of the tokens of some rows, texts on end, and of the tokens before them;
    ``ends``: how often the end token occurs, the context of each text's first word."""

    def __init__(self, rows: pa.RecordBatch, words: str, pairs: str, ends: int) -> None:
        by_text = [unpack(x) for x in rows.column(rows.schema.get_field_index(words)).to_pylist()]
        self.begin = np.cumsum([0, *(len(x) for x in by_text)])[:-1]
        self.word = np.concatenate([x.astype(np.int64) for x in by_text])
        column = rows.column(rows.schema.get_field_index(pairs)).to_pylist()
        self.pair = np.concatenate([unpack(x).astype(np.int64) for x in column])
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.begin] = ends


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def buckets_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], CONTEXTS - 1)


def grid(ratio: np.ndarray) -> np.ndarray:
    """Cells of positive estimates; 0 for those that are 0."""
    with np.errstate(divide="ignore"):
        cell = np.rint(-np.log2(ratio) * GRID) + 1
    return np.where(ratio > 0, cell, 0).astype(np.int64)


def fit(cells: np.ndarray, uniform: float, rounds: int = 50) -> np.ndarray:
    """Weights of (pair, word, uniform) for each bucket, from rows (bucket, pair cell, word
    cell, n); the uniform part keeps a little weight, so nothing has probability 0."""
    weights = np.tile([0.5, 0.4, 0.1], (CONTEXTS, 1))
    if not len(cells):
        return weights
    bucket, pair, word, n = cells.T
    part = np.stack(
        [
            np.where(pair > 0, 2.0 ** (-(pair - 1) / GRID), 0),
            np.where(word > 0, 2.0 ** (-(word - 1) / GRID), 0),
            np.full(len(n), uniform),
        ]
    )
    for _ in range(rounds):
        share = part * weights[bucket].T
        share *= n / share.sum(axis=0)
        gained = np.stack([np.bincount(bucket, s, CONTEXTS) for s in share], axis=1) + [0.01, 0.1, 1.0]
        weights = gained / gained.sum(axis=1, keepdims=True)
    return weights


def score_texts(docs: DataFrame, train: Column, held: Column, id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``train``: rows to learn from; ``held``: those of them that the weights are learned on.
    ``base_score`` is that of single words with one added to each count."""
    part = F.when(~train, 2).when(held, 1).otherwise(0)
    rows = counted(docs.select(F.col(id).cast("long").alias("doc_id"), "text", part.cast("int").alias("part")))
    spark = docs.sparkSession
    free_shuffles(spark)

    stats = rows.where("part < 2").groupBy("part").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("texts"), F.sum("types").alias("types")
    )
    by_part = {r["part"]: r for r in stats.collect()}  # two rows
    n0, all_tokens = (by_part[0]["n"] if 0 in by_part else 0), sum(r["n"] for r in by_part.values())
    ends0, all_ends = (by_part[0]["texts"] if 0 in by_part else 0), sum(r["texts"] for r in by_part.values())
    types = round(sum(r["types"] for r in by_part.values()))
    uniform = 1 / (types + 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            c = Counts(batch, "main_words", "main_pairs", ends0)
            pair, word = c.pair / np.maximum(c.context, 1), c.word / max(n0, 1)
            table = np.stack([buckets_of(c.context), grid(pair), grid(word)])
            cell, n = np.unique(table, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cell), pa.array(n)], names=["b", "p", "w", "n"])

    held_rows = rows.where("part = 1").select("main_words", "main_pairs")
    held_cells = held_rows.mapInArrow(cells, "b long, p long, w long, n long")
    learned = held_cells.groupBy("b", "p", "w").agg(F.sum("n").alias("n")).collect()
    weights = spark.sparkContext.broadcast(fit(np.array([tuple(r) for r in learned], np.int64), uniform))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            c = Counts(batch, "words", "pairs", all_ends)
            w = weights.value[buckets_of(c.context)]
            p = w[:, 0] * c.pair / np.maximum(c.context, 1) + w[:, 1] * c.word / max(all_tokens, 1) + w[:, 2] * uniform
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "n_tokens", "n_known", "base_sum")]
            score = pa.array(np.add.reduceat(np.log10(p), c.begin))
            yield pa.RecordBatch.from_arrays([*kept, score], names=["doc_id", "n_tokens", "n_known", "base_sum", "score"])

    scored = rows.select("doc_id", "n_tokens", "n_known", "base_sum", "words", "pairs").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base_sum double, score double"
    )
    base = F.col("base_sum") - F.col("n_tokens") * math.log10(all_tokens + types + 1)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
