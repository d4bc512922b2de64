"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (a shorter item is one window).  A window
is a set of shingles; for exact containment all of them must be in the document, so it is
enough to look for the one that is rarest in the corpus (the prefix of length one).  Found
in a document, its place in the window bounds where the window must begin and end
(positional and length bounds); there the words themselves are compared.

Windows are taken in blocks of at most ``block`` distinct ones: only a block's index is sent
to the tasks, whatever the size of the benchmark.  With more than one block the documents
carry what was found so far from block to block through the shared folder.

* Null or empty texts have no words and no hits; empty items have no windows.
* Repeated rows are judged alike; an item id given twice counts once; null ids are no items.
* Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import WORDS, ends_of, over, slices, stored, sums_by_run, whole_rows, with_columns

RESULTS = ["n_words", "n_hit", "items"]
#: Words in a shingle, and most distinct windows in a block: with ten words each the codes
#: of their shingles fit 63 bits.
SHINGLE, BLOCK = 3, 100_000


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """words (joined by a space), items: the distinct windows and the ids of their items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts):
                words = text.translate(WORDS).split()
                for i in range(max(min(len(words), 1), len(words) - size + 1)):
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(windows, pa.binary()).cast(pa.string())], names=["item", "words"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL")
    cuts = items.mapInArrow(cut, "item string, words string")
    return cuts.groupBy("words").agg(F.collect_set("item").alias("items"))


@dataclass
class Block:
    """Windows of one block as ids of their own vocabulary."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list) -> Block:
        vocabulary: dict[bytes, int] = {}
        windows = [
            np.array([vocabulary.setdefault(w, len(vocabulary)) for w in r["words"].encode().split()]) for r in rows
        ]
        return cls(vocabulary, windows, [list(r["items"]) for r in rows])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts on end (-1: in no window), and each text's words."""
        words = [t.translate(WORDS).split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        get = self.vocabulary.get
        flat = np.fromiter(
            (i for w in words for i in map(get, w, repeat(-1))), np.int64, int(lengths.sum())
        )
        return flat, lengths

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` words; -1 where a word is unknown."""
        n = max(0, len(ids) - size + 1)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            part = ids[j : j + n]
            code = code * len(self.vocabulary) + part
            known &= part >= 0
        return np.where(known, code, -1)

    def sizes(self) -> list[int]:
        """The lengths of shingles in use: shorter ones only for items of one or two words."""
        return sorted({min(SHINGLE, len(w)) for w in self.windows})


def frequencies(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Documents that hold each shingle of the block, over all documents; (size, code) to count."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wanted = {
            s: np.unique(np.concatenate([own.codes(w, s) for w in own.windows if len(w) >= s])) for s in own.sizes()
        }
        totals = {s: np.zeros(len(c), np.int64) for s, c in wanted.items()}
        for _, texts in slices(batches, "row.text"):
            ids, lengths = own.ids(texts)
            text_of = np.repeat(np.arange(len(texts)), lengths)
            for s, codes in wanted.items():
                found = own.codes(ids, s)
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                hit = np.flatnonzero((codes[at] == found) & (text_of[: len(found)] == text_of[s - 1 :][: len(found)]))
                once = np.unique(text_of[hit] * len(codes) + at[hit])
                totals[s] += np.bincount(once % len(codes), minlength=len(codes))
        for s, codes in wanted.items():
            seen = totals[s] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(seen.sum(), s)), pa.array(codes[seen]), pa.array(totals[s][seen])],
                names=["size", "code", "n"],
            )

    counts = docs.select(F.struct("row.text").alias("row")).mapInArrow(count, "size long, code long, n long")
    # At most the block's shingles come back.
    return {(r["size"], r["code"]): r["n"] for r in counts.groupBy("size", "code").agg(F.sum("n").alias("n")).collect()}


@dataclass
class Prefixes:
    """For each size of shingle: sorted prefix codes, and the windows that each stands for."""

    codes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def prefixes(block: Block, frequency: dict[tuple[int, int], int]) -> dict[int, Prefixes]:
    """The rarest shingle of each window (ties: the first in it)."""
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for k, words in enumerate(block.windows):
        size = min(SHINGLE, len(words))
        codes = block.codes(words, size).tolist()
        offset = min(range(len(codes)), key=lambda j: (frequency.get((size, codes[j]), 0), j))
        if (size, codes[offset]) in frequency:  # else no document holds it
            chosen.setdefault(size, []).append((codes[offset], k, offset))
    out = {}
    for size, rows in chosen.items():
        table = np.array(sorted(rows), np.int64)
        codes, first, count = np.unique(table[:, 0], return_index=True, return_counts=True)
        out[size] = Prefixes(codes, first, count, table[:, 1], table[:, 2])
    return out


def occurrences(
    block: Block, index: dict[int, Prefixes], ids: np.ndarray, lengths: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Window numbers, their begins and their length, for all verified occurrences."""
    begin, end = ends_of(lengths)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    sizes = np.array([len(w) for w in block.windows])
    for size, p in index.items():
        found = block.codes(ids, size)
        at = np.minimum(np.searchsorted(p.codes, found), len(p.codes) - 1)
        hit = np.flatnonzero(p.codes[at] == found)
        per_hit = p.count[at[hit]]
        which = np.repeat(p.first[at[hit]], per_hit) + np.arange(per_hit.sum()) - np.repeat(ends_of(per_hit)[0], per_hit)
        place = np.repeat(hit, per_hit)
        window, start = p.window[which], place - p.offset[which]
        text = text_of[place]
        inside = (start >= begin[text]) & (start + sizes[window] <= end[text])
        window, start = window[inside], start[inside]
        for length in np.unique(sizes[window]).tolist():
            own = sizes[window] == length
            w, s = window[own], start[own]
            distinct, back = np.unique(w, return_inverse=True)
            expected = np.stack([block.windows[k] for k in distinct])[back]
            same = (ids[s[:, None] + np.arange(length)] == expected).all(axis=1)
            yield w[same], s[same], length


def probe(docs: DataFrame, block: Block, index: dict[int, Prefixes]) -> DataFrame:
    """``row, _spans, _items`` with this block's spans and items added."""
    shared = docs.sparkSession.sparkContext.broadcast((block, index))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value
        for batch, texts in slices(batches, "row.text"):
            ids, lengths = own.ids(texts)
            edge = np.zeros(len(ids) + 1, np.int32)
            begin, _ = ends_of(lengths)
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            items = [set(x) for x in batch.column(batch.schema.get_field_index("_items")).to_pylist()]
            for k, flat in enumerate(spans):
                for a, b in zip(flat[::2], flat[1::2]):
                    edge[begin[k] + a] += 1
                    edge[begin[k] + b] -= 1
            text_of = np.repeat(np.arange(len(texts)), lengths)
            for window, start, length in occurrences(own, table, ids, lengths):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                for k, w in set(zip(text_of[start].tolist(), window.tolist())):
                    items[k].update(own.items[w])
            hit = np.cumsum(edge[:-1]) > 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
            merged: list[list[int]] = [[] for _ in texts]
            for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
                while a < b:  # a run of hits may go on in the next text
                    k = text_of[a]
                    stop = min(b, int(begin[k] + lengths[k]))
                    merged[k] += [a - int(begin[k]), stop - int(begin[k])]
                    a = stop
            batch = with_columns(batch, "_spans", _spans=pa.array(merged, pa.list_(pa.int32())))
            batch = with_columns(batch, "_items", _items=pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            batch = with_columns(batch, "n_words", n_words=pa.array(lengths))
            yield with_columns(batch, "n_hit", n_hit=pa.array(sums_by_run(hit.astype(np.int64), lengths)))

    schema = docs.select("row", "_spans", "_items", "n_words", "n_hit").schema
    return docs.mapInArrow(find, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """Adds ``n_words``, ``n_hit`` (words inside occurrences) and ``items`` (ids, sorted as text)."""
    windows = stored(item_windows(benchmark, window), "windows")
    blocks = max(1, -(-windows.count() // block))
    state = whole_rows(docs).select(
        "row",
        F.array().cast("array<int>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
    )
    for k in range(blocks):
        own = Block.of(windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).orderBy("words").collect())
        index = prefixes(own, frequencies(state, own)) if own.windows else {}
        state = probe(state, own, index)
        if k + 1 < blocks:
            state = stored(state, "probed")
    return over(state.withColumnRenamed("_items", "items"), RESULTS)
