"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a graph of nearest neighbours, which is cut into balanced parts by
recursive bisection: halves along the graph's slowest vector, then swaps that gain edges.  A
small network learns in which parts a vector's neighbours lie.  It puts every row of the
table into its likeliest part, and sends each query to the likeliest parts that together
reach ``mass``; there all rows are compared and reranked by exact cosine.

* Parts and the queries sent to them are cut into cells of bounded size, so a vector that a
  third of all rows have spreads over many cells.
* Vectors that are null, zero, or hold null or non-finite components take no part, neither as
  query nor as candidate; so do rows without id.  Vectors of different lengths have no cosine:
  each length is searched apart.
* Equal cosines are ranked by id; equal vectors get bit-equal cosines.  Repeated ids are rows
  of their own: each is a query with ranks from 1, and a candidate for the others.
* A query visits parts until they hold ``k`` other rows, so with fewer candidates than ``k``
  all are returned, and else ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrail.llm.common import stored

#: Candidates and queries of a cell.
CANDIDATES, QUERIES = 4096, 2048
_FOUND = "query long, query_id long, vec_id long, score double"
#: Different lengths of vectors, each searched by a model of its own, that one table may hold.
LENGTHS = 16


def usable(vectors: DataFrame, id: str, column: str) -> DataFrame:
    """``row, vec_id, v``: the vectors that take part, as doubles, and a number of each row."""
    v = F.col(column).cast("array<double>")
    row = F.monotonically_increasing_id().alias("row")
    good = vectors.select(row, F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    v = F.col("v")
    good = good.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return good.where(finite & F.exists(v, lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row's sums depend on that row alone."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k rows of largest cosine, in blocks."""
    out = []
    for at in range(0, len(x), 256):
        near = x[at : at + 256] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out.append(np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, graph: np.ndarray, x: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few edges between them."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[graph[nodes]]
    edge = to >= 0
    a, b = np.nonzero(edge)[0], to[edge]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.maximum(np.bincount(a, minlength=len(nodes)), 1)
    # Power iteration on the walk, from a direction of the vectors themselves.
    f = x[nodes] @ random.normal(size=x.shape[1])
    for _ in range(40):
        f = 0.5 * f + 0.5 * np.bincount(a, f[b], len(nodes)) / degree
        f -= (f * degree).sum() / degree.sum()
        f /= np.abs(f).max() or 1
    side = np.zeros(len(nodes), bool)
    side[np.argsort(f, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(20):
        across = np.bincount(a, side[a] != side[b], len(nodes))
        gain = 2 * across - np.bincount(a, minlength=len(nodes))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        swap = int((gain[left[:n]] + gain[right[:n]] > 1).sum()) // 2
        if not swap:
            break
        before = side.copy()
        side[left[:swap]], side[right[:swap]] = True, False
        if (side[a] != side[b]).sum() >= (before[a] != before[b]).sum():
            side = before
            break
    return nodes[~side], nodes[side]


def partition(graph: np.ndarray, x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Numbers of ``parts`` (a power of two) balanced parts."""
    random, pieces = np.random.default_rng(seed), [np.arange(len(x))]
    while len(pieces) < parts:
        pieces = [half for p in pieces for half in bisect(p, graph, x, random)]
    label = np.empty(len(x), np.int64)
    for k, p in enumerate(pieces):
        label[p] = k
    return label


@dataclass
class Router:
    """A network with one hidden layer."""

    layers: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, seed: int) -> Router:
    """Adam on the cross entropy with the parts of each vector's neighbours."""
    random = np.random.default_rng(seed)
    shape = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    layers = [random.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shape]
    moment = [(np.zeros(s), np.zeros(s)) for s in shape]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            a, b, c, d = layers
            h = np.maximum(x[batch] @ a + b, 0)
            p = Router([a, b, c, d]).probabilities(x[batch])
            error = (p - target[batch]) / len(batch)
            back = (error @ c.T) * (h > 0)
            gradient = [x[batch].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0)]
            step += 1
            for k, g in enumerate(gradient):
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                layers[k] = layers[k] - 0.003 * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * layers[k])
    return Router(layers)


def learn(sample: np.ndarray, parts: int, k: int = 10, hidden: int = 64, epochs: int = 12, seed: int = 3) -> Router:
    """The router of a sample's graph; a sample too small to cut has one part."""
    x = np.unique(unit(sample), axis=0) if len(sample) else np.zeros((1, 1))
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if parts == 1:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbour_graph(x, k)
    label = partition(graph, x, parts, seed)
    target = np.eye(parts)[label] + np.eye(parts)[label[graph]].sum(axis=1)
    return train(x, target / target.sum(axis=1, keepdims=True), hidden, epochs, seed)


def routed(
    vectors: DataFrame, router: Router, mass: float | None, sizes: np.ndarray | None = None, least: int = 0
) -> DataFrame:
    """``row, vec_id, v, part``: the likeliest part of each, or those that together have ``mass``
    and, by the ``sizes`` of all parts, at least so many rows."""
    model = vectors.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            p = model.value.probabilities(unit(x))
            order = np.argsort(-p, axis=1, kind="stable")
            if mass is None:
                row, place = np.arange(len(x)), np.zeros(len(x), int)
            else:
                own = np.take_along_axis(p, order, 1)
                rows = sizes[order]
                before = np.cumsum(own, axis=1) - own
                row, place = np.nonzero((before < mass) | (np.cumsum(rows, axis=1) - rows < least))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(taken),
                    batch.column("vec_id").take(taken),
                    pa.array([x[i].tobytes() for i in row], pa.binary()),
                    pa.array(order[row, place]),
                ],
                names=["row", "vec_id", "v", "part"],
            )

    return vectors.select("row", "vec_id", "v").mapInArrow(route, "row long, vec_id long, v binary, part long")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cells(rows: DataFrame, own: dict[int, int], other: dict[int, int], side: str) -> DataFrame:
    """Rows dealt to the cells of their part: one of their own side's, all of the other's."""

    def count(of: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("part"))

    dealt = rows.where(F.col("part").isin(*own) & F.col("part").isin(*other))
    mine = F.pmod(F.xxhash64("row"), count(own).cast("long")).alias(side)
    theirs = F.explode(F.sequence(F.lit(0).cast("long"), count(other).cast("long") - 1)).alias("q" if side == "c" else "c")
    return dealt.select("row", "vec_id", "v", "part", mine, theirs)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, parts: int = 32, mass: float = 0.95, sample: int = 8192,
    id: str = "vec_id", column: str = "embedding", seed: int = 3,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each query.

    ``is_query`` is a condition on ``vec_id``; the sample is the vectors with the smallest
    hash of their id."""
    good = stored(usable(vectors, id, column), "vectors")
    lengths = [r["n"] for r in good.select(F.size("v").alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    found = [
        search(good.where(F.size("v") == n), is_query, k, parts, mass, sample, seed) for n in sorted(lengths)
    ]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found) if found else none


def search(
    good: DataFrame, is_query: Column, k: int, parts: int, mass: float, sample: int, seed: int
) -> DataFrame:
    """`nearest` of usable vectors of one length."""
    picked = good.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "row").limit(sample).select("v").collect()
    router = learn(np.array([r["v"] for r in picked]), parts, seed=seed)
    rows = stored(routed(good, router, None), "parts")
    held = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    each = np.zeros(router.layers[-1].size, np.int64)
    each[list(held)] = list(held.values())
    queries = stored(routed(good.where(is_query), router, mass, each, k + 1), "queries")
    sizes = {part: -(-n // CANDIDATES) for part, n in held.items()}
    asked = {r["part"]: -(-r["count"] // QUERIES) for r in queries.groupBy("part").count().collect()}
    if not asked:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _found([], [], [], [])
        q, c = (np.stack([np.frombuffer(v) for v in t.column("v").to_pylist()]) for t in (queries, rows))
        qid, cid = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        qrow, crow = queries.column("row").to_numpy(), rows.column("row").to_numpy()
        order = np.lexsort((crow, cid))
        c, cid, crow = c[order], cid[order], crow[order]
        # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
        _, same = np.unique(c, axis=0, return_inverse=True)
        by = np.argsort(same, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        keep = np.sort(by[rank <= k])
        c, cid, crow = c[keep], cid[keep], crow[keep]
        near = unit(q) @ unit(c).T
        near[qrow[:, None] == crow[None, :]] = -2
        n = min(k, len(cid))
        least = np.partition(near, len(cid) - n, axis=1)[:, len(cid) - n]
        a, b = np.nonzero((near >= least[:, None] - 1e-9) & (near > -1.5))
        score = cosine(q[a], c[b])
        order = np.lexsort((cid[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.arange(len(a)) - np.searchsorted(a, a) < k
        return _found(qrow[a[first]], qid[a[first]], cid[b[first]], score[first])

    left = cells(queries, asked, sizes, "q").groupBy("part", "q", "c")
    right = cells(rows, sizes, asked, "c").groupBy("part", "q", "c")
    found = left.cogroup(right).applyInArrow(best, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(queries, ids, rows, scores) -> pa.Table:
    columns = {"query": queries, "query_id": ids, "vec_id": rows}
    return pa.table({**{n: pa.array(v, pa.int64()) for n, v in columns.items()}, "score": pa.array(scores, pa.float64())})
