"""N-gram Jaccard join: components of documents whose shingle sets are similar enough.

1. Document frequencies of all shingles order each set from rare to frequent.  Sets with
   Jaccard similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of each, so
   sets whose prefix has only shingles that no other document has are done.
2. Equal sets are one class from here on.  Classes that share a prefix shingle, directly or
   by way of others, form a cluster; all possible links lie inside clusters.
3. Clusters are cut into blocks of bounded size.  Each block builds a signature tree: nodes
   hold the OR of their sets' bitmaps and their range of sizes.  Pairs of nodes are
   traversed together and dropped when the largest possible overlap is too small, or when
   all their sets are in one component already; pairs of leaves are compared exactly.
4. Clusters of more than one block: first one set of each component is compared, then
   blocks are formed anew, by component, and every pair of blocks is traversed but those
   that lie wholly in one component.  No link between different components is lost.

* A document with fewer words than a shingle has one: all its words.  Without words its set
  is empty and links with nothing.
* Rows with one id are one document; rows without id take no part, their component is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import (
    LOWER,
    U,
    ends_of,
    free_shuffles,
    hashed_words,
    lean,
    mixed,
    stored,
    sums_by_run,
    text_bytes,
    window_hashes,
)
from playtrail.llm.components import components
from playtrail.llm.packed import SENT, chunks_for, corpus_counts, counts_for, distinct, in_chunks, sent

#: Classes of a block; sets of a leaf.
BLOCK, LEAF = 512, 16
_SETS = "doc_id long, n_shingles long, h1 long, h2 long, prefix array<long>, tokens array<long>"


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts on end (sorted in each), the texts they
    belong to, and the size of each text's set."""
    flat, lengths = hashed_words((t or "").encode().translate(LOWER) for t in texts)
    begin, end = ends_of(lengths)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    hashes = window_hashes(flat, size)
    whole = np.flatnonzero(np.arange(len(hashes)) + size <= end[text_of[: len(hashes)]])
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    single = np.array([window_hashes(flat[begin[k] : end[k]], lengths[k], 0xC2B2AE3D27D4EB4F)[0] for k in short], U)
    hashes = np.concatenate([hashes[whole], single])
    owner = np.concatenate([text_of[whole], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return hashes, owner, np.bincount(owner, minlength=len(lengths))


def prefix_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """For each row of ``doc_id, text``: size and digest of its set, the shingles of its
    prefix that occur elsewhere, and, if there are any, all its shingles that do."""
    n = chunks_for(text_bytes(docs))
    chunked = in_chunks(docs, n)

    def send(chunk: pa.Table) -> pa.Table:
        hashes, _, _ = shingle_sets(chunk.column("text").to_pylist(), shingle)
        # Four bytes beside the bucket: a false repeat only makes a prefix longer.
        return sent(chunk.column("chunk")[0].as_py(), *distinct(hashes), n, width=4)

    counts = corpus_counts(chunked.groupBy("chunk").applyInArrow(lean(send), SENT), most=255)

    def prefix(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, owner, sizes = shingle_sets(chunk.column("text").to_pylist(), shingle)
        keys, own = distinct(hashes)
        (total,), _ = counts_for(keys, own, answers, n)
        frequency = total[np.searchsorted(keys, hashes)]
        sums = [
            sums_by_run(mixed(hashes ^ U(seed)), sizes).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
        ]
        order = np.lexsort((hashes, frequency, owner))
        hashes, frequency = hashes[order].view(np.int64), frequency[order]
        rank = np.arange(len(hashes)) - ends_of(sizes)[0][owner]
        longest = sizes - (percent * sizes + 99) // 100 + 1
        shared = frequency > 1
        first = shared & (rank < longest[owner])
        has = sums_by_run(first.astype(np.int64), sizes) > 0
        shared &= has[owner]
        return pa.table(
            {
                "doc_id": chunk.column("doc_id"),
                "n_shingles": pa.array(sizes),
                "h1": pa.array(sums[0]),
                "h2": pa.array(sums[1]),
                "prefix": lists(hashes[first], owner[first], len(sizes)),
                "tokens": lists(hashes[shared], owner[shared], len(sizes)),
            }
        )

    found = chunked.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lean(prefix), _SETS)
    return stored(found, "sets")


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list of values for each of n owners; owners ascend."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


class SignatureTree:
    """Sets in order of size, in a binary tree over leaves of LEAF sets."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, label: np.ndarray, percent: int) -> None:
        order = np.lexsort((label, sizes))
        self.order, self.bitmaps, self.sizes, self.label = order, bitmaps[order], sizes[order], label[order]
        self.percent = percent
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}
        self.node(0, len(sizes))

    def node(self, a: int, b: int) -> np.ndarray:
        """Builds a node's OR-combined bitmap and size range, children first."""
        if b - a <= LEAF:
            both = np.bitwise_or.reduce(self.bitmaps[a:b])
        else:
            both = self.node(a, (a + b) // 2) | self.node((a + b) // 2, b)
        self.nodes[a, b] = both, int(self.sizes[a]), int(self.sizes[b - 1])
        return both

    def possible(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        """Whether any set of one node can link with any of the other, and matters."""
        label = self.label[x[0]]
        if (self.label[x[0] : x[1]] == label).all() and (self.label[y[0] : y[1]] == label).all():
            return False
        (bits, least, most), (bits_y, least_y, most_y) = self.nodes[x], self.nodes[y]
        if 100 * most < self.percent * least_y or 100 * most_y < self.percent * least:
            return False
        overlap = min(most, most_y, int(np.bitwise_count(bits & bits_y).sum()))
        return (100 + self.percent) * overlap >= self.percent * (least + least_y)

    def links(self) -> np.ndarray:
        """For each set, by its original number, a label that it shares with all sets it is
        linked with, directly or through others."""
        stack = [((0, len(self.sizes)),) * 2]
        while stack:
            x, y = stack.pop()
            if not self.possible(x, y):
                continue
            if x[1] - x[0] <= LEAF and y[1] - y[0] <= LEAF:
                self.compare(x, y)
            elif x == y:
                a, b = x
                m = (a + b) // 2
                stack += [((a, m), (m, b)), ((m, b), (m, b)), ((a, m), (a, m))]
            else:
                wide, other = (x, y) if x[1] - x[0] >= y[1] - y[0] else (y, x)
                m = (wide[0] + wide[1]) // 2
                stack += [((wide[0], m), other), ((m, wide[1]), other)]
        label = np.empty_like(self.label)
        label[self.order] = self.label
        return label

    def compare(self, x: tuple[int, int], y: tuple[int, int]) -> None:
        both = self.bitmaps[x[0] : x[1], None] & self.bitmaps[None, y[0] : y[1]]
        overlap = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
        total = self.sizes[x[0] : x[1], None] + self.sizes[None, y[0] : y[1]]
        for i, j in zip(*np.nonzero((100 + self.percent) * overlap >= self.percent * total)):
            a, b = x[0] + int(i), y[0] + int(j)
            if self.label[a] != self.label[b]:
                self.label[self.label == self.label[b]] = self.label[a]


def tree_links(members: DataFrame, percent: int) -> DataFrame:
    """Stars ``doc_id, head`` of what is linked inside each block of ``block, doc_id,
    n_shingles, tokens, component`` (sets of one component are linked already)."""

    def join(block: pa.Table) -> pa.Table:
        ids = block.column("doc_id").to_numpy()
        tokens = block.column("tokens").combine_chunks()
        lengths = np.diff(tokens.offsets.to_numpy())
        flat, owner = tokens.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lengths)
        _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        # Bits for shingles that two sets of the block have: an AND counts the whole overlap.
        bit = np.cumsum(count > 1) - 1
        keep = count[back] > 1
        bitmaps = np.zeros((len(ids), -(-int((count > 1).sum()) // 64) or 1), U)
        at = bit[back[keep]]
        np.bitwise_or.at(bitmaps, (owner[keep], at // 64), U(1) << (at % 64).astype(U))
        _, label = np.unique(block.column("component").to_numpy(), return_inverse=True)
        label = SignatureTree(bitmaps, block.column("n_shingles").to_numpy().astype(np.int64), label, percent).links()
        head = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(head, label, ids)
        return pa.table({"doc_id": pa.array(ids), "head": pa.array(head[label])})

    return members.groupBy("block").applyInArrow(join, "doc_id long, head long")


def cluster_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links ``a, b`` that connect all that is connected inside the clusters of ``cluster,
    doc_id``.  Only ids move until blocks are known; ``sets`` has the sets of all ids."""

    def trees(placed: DataFrame, sets: DataFrame) -> DataFrame:
        return tree_links(placed.select("doc_id", "component", "block").join(sets, "doc_id"), percent)

    counted = stored(members.join(members.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"), "members")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / block))
    first = counted.withColumn("component", F.col("doc_id")).withColumn("block", F.struct("cluster", part.alias("part")))
    inside = stored(trees(first, sets), "links")
    links = inside.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    large = counted.where(F.col("n") > block)
    if large.isEmpty():
        return links

    # One set of each component so far stands for it.
    large = stored(large.join(inside, "doc_id"), "large")
    sets = stored(large.select("doc_id").join(sets, "doc_id"), "large-sets")
    heads = large.where("doc_id = head").drop("n")
    heads = heads.join(heads.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    heads = heads.withColumn("component", F.col("doc_id")).withColumn("block", F.struct("cluster", part.alias("part")))
    across = stored(trees(heads, sets), "links")
    links = links.union(across.select("doc_id", "head"))
    across = across.select(F.col("doc_id").alias("head"), F.col("head").alias("component"))
    large = large.join(across, "head")

    # Components of half a block and more have blocks of their own; small ones share blocks.
    sizes = large.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    own = F.when(F.col("size") * 2 >= block, F.col("component"))
    part = F.when(own.isNotNull(), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / block))).otherwise(
        F.pmod(F.xxhash64("component"), F.ceil(F.col("n") / block))
    )
    large = stored(
        large.join(sizes, ["cluster", "component"]).withColumn("part", F.struct(own.alias("own"), part.alias("part"))),
        "parts",
    )
    parts = large.select("cluster", "part").distinct().withColumn("own", F.col("part.own"))
    other = parts.select("cluster", F.col("part").alias("part_b"), F.col("own").alias("own_b"))
    cells = parts.join(other, "cluster").where(
        "(part < part_b AND NOT coalesce(own = own_b, false)) OR (part = part_b AND own IS NULL)"
    )
    cells = cells.select("cluster", "part", "part_b", F.struct("cluster", "part", "part_b").alias("block"))
    sides = cells.select("cluster", "part", "block").union(cells.select("cluster", "part_b", "block")).distinct()
    return links.union(trees(large.join(sides, ["cluster", "part"]), sets).select("doc_id", "head"))


def jaccard_components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK, id: str = "doc_id"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; documents link from ``percent``."""
    sets = prefix_sets(docs.select(F.col(id).cast("long").alias("doc_id"), "text"), shingle, percent)
    free_shuffles(docs.sparkSession)
    linked = sets.where((F.size("prefix") > 0) & F.col("doc_id").isNotNull())
    classes = stored(
        linked.groupBy("h1", "h2").agg(
            F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("first")
        ).select("h1", "h2", "first.*"),
        "classes",
    )
    postings = classes.select("doc_id", F.explode("prefix").alias("token"))
    heads = postings.groupBy("token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most")).where("a < most")
    edges = postings.join(heads, "token").select("a", F.col("doc_id").alias("b")).distinct()
    clusters = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    # An id with several texts has a set for each of them.
    own_sets = sets.where(F.size("prefix") > 0).select("doc_id", "n_shingles", "tokens")
    links = cluster_links(clusters, own_sets, percent, block)
    found = components(links).withColumnRenamed("node", "rep")
    reps = classes.select("h1", "h2", F.col("doc_id").alias("rep")).join(found, "rep", "left")
    rows = sets.select("doc_id", "n_shingles", "h1", "h2").join(reps, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(None)
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id")
    )
