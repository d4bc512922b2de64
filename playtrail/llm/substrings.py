"""Substring dedup: removes words inside runs of ``window`` words that start elsewhere too.

1. Every window contains an anchor: the smallest hash of its GRAM-word runs.  Equal windows
   have equal anchors, so only windows around anchors that occur twice can be repeated.
2. An anchor's context is all windows that it stands for.  A context that occurs twice as a
   whole is repeated; this takes copies of documents and the insides of shared passages out,
   however many there are.
3. What is left are contexts of one anchor that differ.  They are the reference shard of a
   suffix automaton; streamed through it they give matching statistics capped at the window,
   whose states count each window's occurrences, and the maximal spans to remove.
4. Anchors with more than HOT places don't form a shard: their windows are counted one by
   one, by hash, in the second step.  So a shard has a bound, and nothing is left out.

Shards meet their contexts by a shuffle on the anchor: broadcasting every shard to every
task would compare each document with the whole corpus, which grows with its square.

Windows are judged on the input; a window may overlap its other place.  Null and empty texts
have no words; texts shorter than a window stay whole.  Repeated rows are places of their
own, so both lose their text.  A text that loses nothing is returned unchanged, null too.
Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import (
    U,
    ends_of,
    hashed_words,
    lean,
    mixed,
    over,
    row_and,
    sums_by_run,
    text_bytes,
    whole_rows,
    window_hashes,
)
from playtrail.llm.packed import SENT, chunks_for, corpus_counts, counts_for, distinct, in_chunks, sent

GRAM = 8
#: Places of an anchor from which its windows are counted one by one.
HOT = 1024
_MOST = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_CONTEXT = "anchor long, weight int, chunk long, place int, text binary"
RESULTS = ["n_words", "n_removed", "kept"]


def sliding(op: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """op over each run of ``size`` values."""
    have = 1
    while have < size and len(values):
        step = min(have, size - have)
        values, have = op(values[:-step], values[step:]), have + step
    return values


class Chunk:
    """The words of a chunk's texts on end, in an order that does not depend on the shuffle."""

    def __init__(self, table: pa.Table, window: int) -> None:
        texts = pa.chunked_array([c.field("text") for c in table.column("row").chunks], pa.string())
        self.order = pc.sort_indices(texts)
        self.table = table.take(self.order)
        self.number = table.column("chunk")[0].as_py()
        self.texts = texts.take(self.order).cast(pa.binary()).to_pylist()
        self.flat, self.lengths = hashed_words(self.texts)
        self.begin, self.end = ends_of(self.lengths)
        self.text_of = np.repeat(np.arange(len(self.texts), dtype=np.int32), self.lengths)
        self.window = window
        self.gram = max(1, min(GRAM, window // 2))
        self.find_anchors()

    def words(self, k: int) -> list[bytes]:
        return (self.texts[k] or b"").split()

    def find_anchors(self) -> None:
        """Places and hashes of the smallest runs of all windows."""
        runs = self.window - self.gram + 1
        grams = window_hashes(self.flat, self.gram)
        least = sliding(np.minimum, grams, runs)[: max(0, len(self.flat) - self.window + 1)]
        whole = np.arange(self.window, self.window + len(least)) <= self.end[self.text_of[: len(least)]]
        least[~whole] = 0
        pad = np.zeros(runs - 1, U)
        least = np.concatenate([pad, least, pad])
        reach = sliding(np.maximum, least, runs)
        self.place = np.flatnonzero(grams == reach[: len(grams)]) if len(grams) >= runs else np.zeros(0, np.int64)
        self.anchor = grams[self.place]

    def contexts(self, answers: pa.Table, buckets: int, most: int) -> None:
        """Begin, end, key and anchor count of the contexts of repeated anchors, and the
        begins and keys of the windows of hot ones, which have more than ``most`` places."""
        keys, own = distinct(self.anchor)
        (total,), _ = counts_for(keys, own, answers, buckets)
        count = total[np.searchsorted(keys, self.anchor)]
        again = count > 1
        place, anchor, count = self.place[again], self.anchor[again], count[again]
        text = self.text_of[place]
        low = np.maximum(self.begin[text], place - (self.window - self.gram))
        high = np.minimum(self.end[text], place + self.window)
        # A window belongs to the first of several equal anchors in it: it counts once.
        order = np.lexsort((place, anchor, text))
        same = (anchor[order][1:] == anchor[order][:-1]) & (text[order][1:] == text[order][:-1])
        low[order[1:]] = np.where(same, np.maximum(low[order[1:]], place[order[:-1]] + 1), low[order[1:]])
        full = high - low >= self.window
        low, high, anchor, count = low[full], high[full], anchor[full], count[full]

        hot = count > most
        edge = np.zeros(len(self.flat) + 1, np.int64)
        np.add.at(edge, low[hot], 1)
        np.add.at(edge, high[hot] - self.window + 1, -1)
        self.hot_begin = np.flatnonzero(np.cumsum(edge) > 0)
        hashes = window_hashes(self.flat, self.window, 0xC2B2AE3D27D4EB4F) if len(self.hot_begin) else self.flat
        self.hot_key = hashes[self.hot_begin]

        self.low, self.high, self.of, self.count = low[~hot], high[~hot], anchor[~hot], count[~hot]
        self.key = mixed(self.range_hashes(self.low, self.high) ^ mixed(self.of + (self.high - self.low).astype(U)))

    def range_hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of runs of any length: differences of one running polynomial."""
        power = np.cumprod(np.full(len(self.flat) + 1, _BASE, U))
        back = np.cumprod(np.full(len(self.flat) + 1, pow(_BASE, -1, 1 << 64), U))
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.flat * power[:-1])])
        return (total[high] - total[low]) * back[low]

    def repeats(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context how often it occurs, and whether this is the place that stands
        for all; ``hot_again``: the same count for hot windows."""
        keys, own = distinct(np.concatenate([self.key, self.hot_key]))
        (total,), owned = counts_for(keys, own, answers, buckets)
        self.hot_again = total[np.searchsorted(keys, self.hot_key)]
        at = np.searchsorted(keys, self.key)
        first = np.zeros(len(self.key), bool)
        first[np.unique(self.key, return_index=True)[1]] = True
        return total[at], owned[at] & first


class SuffixAutomaton:
    """Suffix automaton of a set of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self.extend(last, word)

    def extend(self, last: int, word: bytes) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self.split(last, known, word)
        new = self.state({}, length[last] + 1)
        while last >= 0 and word not in step[last]:
            step[last][word] = new
            last = link[last]
        if last < 0:
            link[new] = 0
        else:
            known = step[last][word]
            link[new] = known if length[known] == length[last] + 1 else self.split(last, known, word)
        return new

    def state(self, arrows: dict, length: int) -> int:
        self.next.append(arrows)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, last: int, known: int, word: bytes) -> int:
        """A state for the shorter words of ``known``, which go on in more ways."""
        step, link = self.next, self.link
        clone = self.state(dict(step[known]), self.length[last] + 1)
        link[clone], link[known] = link[known], clone
        while last >= 0 and step[last].get(word) == known:
            step[last][word] = clone
            last = link[last]
        return clone

    def matches(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """Matching statistics from ``window`` on: ends, and the states of the last
        ``window`` words, of a sequence streamed through."""
        step, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            if matched >= window:
                yield at + 1, state


def repeated_spans(contexts: list[tuple[int, list]], window: int) -> list[list[tuple[int, int]]]:
    """For each context (how often it occurs, words): the maximal spans of its words inside
    windows that occur at least twice in all."""
    automaton = SuffixAutomaton()
    for _, words in contexts:
        automaton.add(words)
    seen: dict[int, int] = {}
    streamed = [list(automaton.matches(words, window)) for _, words in contexts]
    for (weight, _), found in zip(contexts, streamed):
        for _, state in found:
            seen[state] = seen.get(state, 0) + weight
    out = []
    for found in streamed:
        spans: list[tuple[int, int]] = []
        for end, state in found:
            if seen[state] > 1:
                begin = end - window
                if spans and begin <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((begin, end))
        out.append(spans)
    return out


def shard_spans(contexts: DataFrame, window: int) -> DataFrame:
    """Spans (chunk, place, stop) of the contexts that occur once as a whole."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            shard = list(group)
            if len(shard) > 1:
                found = repeated_spans([(r[1], r[4].split()) for r in shard], window)
                for (_, weight, chunk, place, _), spans in zip(shard, found):
                    if weight == 1:
                        out += [(chunk, place + a, place + b) for a, b in spans]
            if len(out) > 50_000:
                yield _spans(out)
                out = []
        yield _spans(out)

    shards = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return shards.mapInArrow(stream, "chunk long, place int, stop int")


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["chunk", "place", "stop"]
    )


def answers_of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def remove_repeats(docs: DataFrame, window: int = 35, hot_from: int = HOT) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept``: the text without repeated words."""
    n = chunks_for(text_bytes(docs))
    chunked = in_chunks(whole_rows(docs), n)
    by_chunk = chunked.groupBy("chunk")

    def anchor_keys(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        return sent(chunk.number, *distinct(chunk.anchor), n)

    def context_keys(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        chunk.contexts(answers_of(answers, 1), n, hot_from)
        return sent(chunk.number, *distinct(np.concatenate([chunk.key, chunk.hot_key])), n)

    def different(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        chunk.contexts(answers_of(answers, 1), n, hot_from)
        times, stands = chunk.repeats(answers_of(answers, 2), n)
        # Where all places of an anchor have one context, there is nothing to compare.
        chosen = np.flatnonzero(((times == 1) | stands) & (times < chunk.count))
        low, high = chunk.low[chosen], chunk.high[chosen]
        text = chunk.text_of[low]
        first = chunk.begin[text]
        parts, own, words = [], -1, []
        for k, a, b in zip(text.tolist(), (low - first).tolist(), (high - first).tolist()):
            if k != own:
                own, words = k, chunk.words(k)
            parts.append(b" ".join(words[a:b]))
        return pa.table(
            {
                "anchor": pa.array(chunk.of[chosen].view(np.int64)),
                "weight": pa.array(np.minimum(times[chosen], 2), pa.int32()),
                "chunk": pa.array(np.full(len(chosen), chunk.number)),
                "place": pa.array(low, pa.int32()),
                "text": pa.array(parts, pa.binary()),
            }
        )

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        chunk.contexts(answers_of(answers, 1), n, hot_from)
        times, _ = chunk.repeats(answers_of(answers, 2), n)
        spans = answers_of(answers, 3)
        hot = chunk.hot_begin[chunk.hot_again > 1]
        edge = np.zeros(len(chunk.flat) + 1, np.int64)
        np.add.at(edge, np.concatenate([chunk.low[times > 1], hot, spans.column("place").to_numpy()]), 1)
        np.add.at(edge, np.concatenate([chunk.high[times > 1], hot + window, spans.column("stop").to_numpy()]), -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = sums_by_run(gone.astype(np.int64), chunk.lengths)
        kept: list[bytes | None] = []
        for k, text in enumerate(chunk.texts):
            if removed[k]:
                stays = np.flatnonzero(~gone[chunk.begin[k] : chunk.end[k]]).tolist()
                words = chunk.words(k)
                text = b" ".join([words[i] for i in stays])
            kept.append(text)
        return pa.table(
            {
                "row": chunk.table.column("row"),
                "n_words": pa.array(chunk.lengths),
                "n_removed": pa.array(removed),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    def answer(df: DataFrame, kind: int) -> DataFrame:
        for name, sql in (("bucket", "long"), ("counts", "binary"), ("flags", "binary"), ("place", "int"), ("stop", "int")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(sql))
        return df.select("chunk", F.lit(kind).alias("kind"), "bucket", "counts", "flags", "place", "stop")

    anchors = answer(corpus_counts(by_chunk.applyInArrow(lean(anchor_keys), SENT), most=_MOST), 1)
    keys = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(lean(context_keys), SENT)
    counts = anchors.union(answer(corpus_counts(keys, most=_MOST), 2))
    contexts = by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(lean(different), _CONTEXT)
    found = counts.union(answer(shard_spans(contexts, window), 3))
    whole = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(
        lean(cut), row_and(chunked, "n_words long, n_removed long, kept string")
    )
    return over(whole, RESULTS)
