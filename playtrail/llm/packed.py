"""Corpus-wide counts of many keys, without a row for each key.

A corpus has as many shingles or word pairs as words; exploding them into rows makes Spark
move many times the text.  Here the documents are dealt to chunks of bounded size by a hash.
Each chunk sends its distinct keys, packed into one binary value for each bucket of keys;
each bucket adds up what all chunks sent and answers each of them, again packed.  Spark
does the grouping and shuffling; inside a task there are only sorted arrays.

Chunks are even because rows are dealt by a hash of content and place, buckets because a
chunk sends each key once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import U, lean

#: Text bytes of a chunk.
CHUNK_BYTES = 8 << 20
SENT = "chunk long, bucket long, keys binary, counts binary"
ANSWER = "chunk long, bucket long, counts binary, flags binary"


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """The rows with a column ``chunk``, partitioned by it.

    Rows are dealt by content and place in the input, so equal rows part too.  As all who read
    by place (and Spark when it deals rows in turn), this wants an input that is read alike
    again, after a lost task or by a second query: files, such as a stored table, not the
    result of a shuffle."""
    key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), F.monotonically_increasing_id())
    return docs.withColumn("chunk", F.pmod(key, F.lit(chunks).cast("long"))).repartition("chunk")


def chunks_for(size: int, each: int = CHUNK_BYTES) -> int:
    """Chunks for so many bytes of text; also the buckets of keys."""
    return max(8, -(-size // each))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs (1, 2, 4 or 8)."""
    kind = np.min_scalar_type(int(values.max())) if values.size else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def _key_bytes(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _within(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What a bucket's number doesn't tell of its keys; ascending if they are."""
    return ((keys >> U(32)) // U(buckets) << U(32)) | (keys & U(0xFFFFFFFF))


def _key_steps(keys: np.ndarray, buckets: int) -> bytes:
    """A bucket's ascending keys, whole, as differences of what its number doesn't tell of
    them; in as few bytes each as the largest needs."""
    steps = np.diff(_within(keys, buckets), prepend=U(0))
    return _key_bytes(steps, max(1, -(-int(steps.max()).bit_length() // 8)))


def _keys(data: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :width] = part
    return whole.view("<u8").ravel()


def _buckets(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and positions of its keys; by the keys' high bits, which are not sent."""
    bucket = (keys >> U(32)) % U(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), part


def distinct(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and one row of sums for each array of weights (none: of ones)."""
    own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    if not weights:
        return own, count[None, :]
    return own, np.stack([np.bincount(back, w, len(own)).astype(np.int64) for w in weights])


def sent(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: int | None = 8, kind: int = 0) -> pa.Table:
    """What a chunk sends to the buckets: rows of SENT.

    ``width``: bytes of a key that are sent; keys are told apart by these and by their
    bucket.  None: whole ascending keys as steps.  ``kind`` numbers kinds of keys that are counted apart."""

    def packed(own: np.ndarray) -> bytes:
        return _key_steps(own, buckets) if width is None else _key_bytes(own, width)

    rows = [
        (chunk, kind * buckets + b, packed(keys[part]), pack(counts[:, part].ravel()))
        for b, part in _buckets(keys, buckets)
    ]
    return _table(rows, ["chunk", "bucket", "keys", "counts"])


def corpus_counts(rows: DataFrame, sums: int = 1, most: int | None = None, steps: bool = False) -> DataFrame:
    """An answer to each row of ``sent``, for ``counts_for``: the counts of its keys summed
    over all chunks, where they differ from what the chunk sent itself.

    ``sums``: counts of a key; ``most``: sums stop there; ``steps``: keys were sent
    with width None, and a check sum goes back with the flags, for ``counts_for``."""

    def add(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("chunk")
        chunks = bucket.column("chunk").to_pylist()
        counts = [unpack(c).reshape(sums, -1) for c in bucket.column("counts").to_pylist()]
        lengths = [c.shape[1] for c in counts]
        keys = [_keys(k, len(k) // n) for k, n in zip(bucket.column("keys").to_pylist(), lengths)]
        if steps:
            keys = [np.cumsum(k, dtype=U) for k in keys]
            checks = [_check(k, c) for k, c in zip(keys, counts)]
        _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        own = np.concatenate(counts, axis=1).astype(np.int64)
        total = np.stack([np.bincount(back, c).astype(np.int64) for c in own])[:, back]
        if most is not None:
            total = np.minimum(total, most)
        more = (total != own).any(axis=0)
        owned = np.zeros(len(back), bool)
        owned[first] = True
        number, found, at = bucket.column("bucket")[0].as_py(), [], 0
        for i, (chunk, n) in enumerate(zip(chunks, lengths)):
            part = slice(at, at + n)
            flags = np.packbits(np.stack([owned[part], more[part]])).tobytes()
            if steps:
                flags += checks[i]
            found.append((chunk, number, pack(total[:, part][:, more[part]].ravel()), flags))
            at += n
        return _table(found, ["chunk", "bucket", "counts", "flags"])

    return rows.groupBy("bucket").applyInArrow(lean(add), ANSWER)


def counts_for(
    keys: np.ndarray, counts: np.ndarray, answers: pa.Table, buckets: int, kind: int = 0, steps: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """For what a chunk sent: the sums over all chunks, and whether the chunk is the first
    (by number) that holds the key.

    ``steps``: as in ``corpus_counts``; it is an error if a chunk was read again and no longer
    holds what it sent, since the answers don't fit it."""
    found = {b: (c, f) for b, c, f in zip(*(answers.column(n).to_pylist() for n in ("bucket", "counts", "flags")))}
    total, owned = counts.astype(np.int64), np.zeros(len(keys), bool)
    parts = dict(_buckets(keys, buckets))
    if steps and {b for b in found if b // buckets == kind} != {kind * buckets + b for b in parts}:
        raise ValueError(_CHANGED)
    for b, part in parts.items():
        sums, flags = found[kind * buckets + b]
        if steps and not flags.endswith(_check(_within(keys[part], buckets), counts[:, part])):
            raise ValueError(_CHANGED)
        bits = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * len(part)).astype(bool)
        owned[part], more = bits[: len(part)], bits[len(part) :]
        total[:, part[more]] = unpack(sums).reshape(len(total), -1)
    return total, owned


_CHANGED = "a chunk no longer holds the texts that were counted: the input must read alike each time"


def _check(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A check sum of keys with their counts."""
    weight = U(1)
    for row in counts:
        weight = weight * U(0x9E3779B97F4A7C15) + row.astype(U)
    return (keys * weight).sum(dtype=U).tobytes()


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(names)
    types = [pa.int64() if n in ("chunk", "bucket") else pa.binary() for n in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})
