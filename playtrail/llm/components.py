"""Connected components of a graph given as edges.

Each round joins what lies in one partition (a spanning forest by union-find, which is a
combination before the shuffle), then makes large and small stars across partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import stored

#: Edges of a partition that is joined on its own.
EDGES = 500_000


def forest(edges: DataFrame, count: int) -> DataFrame:
    """Stars ``hi, lo`` that connect what the edges inside each partition connect."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = np.array([(x, root(x)) for x in list(parent) if root(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["hi", "lo"])

    return edges.select("hi", "lo").coalesce(max(1, count // EDGES)).mapInArrow(join, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of edges ``a, b`` between
    different nodes.  Each round is written, so a lost executor costs one round at most."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    found = stored(pairs, "edges")
    stars = stored(forest(found, found.count()), "stars")
    while not joined(stars):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = stored(forest(small.union(root.select("hi", F.col("m").alias("lo"))), stars.count()), "stars")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        stars.select("lo", "lo").distinct()
    )


def joined(stars: DataFrame) -> bool:
    """Whether each node has one centre and no centre has one itself."""
    ends = stars.select(F.col("hi").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("centre")).union(
        stars.select("lo", F.lit(0), F.lit(1))
    )
    by_node = ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("centre").alias("centre"))
    return by_node.where("own > 1 OR (own = 1 AND centre = 1)").isEmpty()
