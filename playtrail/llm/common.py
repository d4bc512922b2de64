"""Helpers of the operators: words, hashes, input in batches, stored tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z to a-z, other bytes as they are.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z, and every ASCII byte that is neither letter nor digit to a space.
WORDS = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
#: Text bytes that one step inside a task handles at once.
SLICE_BYTES = 4 << 20

U = np.uint64


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def slices(
    batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches with about so many bytes of text, and their texts (null: empty).

    ``text`` names a column or, after a point, a field of a struct column."""
    name, _, field = text.partition(".")
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        column = (column.field(field) if field else column).cast(pa.binary())
        if not len(column):
            continue
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
        part = np.cumsum(sizes, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for begin, end in zip(edges, edges[1:]):
            yield batch.slice(begin, end - begin), [t or b"" for t in column.slice(begin, end - begin).to_pylist()]


def release_memory() -> None:
    """Give back what a finished group held.  Workers are used again, and Arrow's pool and the
    C library keep freed memory for later, so a worker would stay as large as its largest group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def lean(f: Callable) -> Callable:
    """``f`` for ``applyInArrow``, by one or two tables, that releases what a large group held."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            if sum(t.nbytes for t in tables) > 1 << 20:
                release_memory()

    # Spark looks at how many arguments a function takes.
    return (lambda table: run(table)) if f.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``: no column name of the input can clash with another."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def row_and(rows: DataFrame, results: str) -> T.StructType:
    """The schema of ``row`` as it is, and of results given as SQL."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(results)])


def with_columns(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    """The batch without one column and with others at the end."""
    kept = [i for i, name in enumerate(batch.schema.names) if name != drop]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), *columns.values()],
        names=[*(batch.schema.names[i] for i in kept), *columns],
    )


def over(df: DataFrame, results: list[str]) -> DataFrame:
    """The columns of ``row`` followed by results, which replace columns of the same name."""
    names = {n.lower() for n in results}
    kept = [f for f in df.schema["row"].dataType.names if f.lower() not in names]
    return df.select(*(F.col("row").getField(n).alias(n) for n in kept), *results)


def hashed_words(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (by ASCII white space) of all texts on end, and their number
    in each.  A text's words are objects only while they are hashed: those of a whole group
    would take ten times its bytes."""
    from xxhash import xxh64_intdigest

    hashes = [np.fromiter(map(xxh64_intdigest, (t or b"").split()), U) for t in texts]
    return np.concatenate([np.zeros(0, U), *hashes]), np.fromiter(map(len, hashes), np.int64, len(hashes))


def ends_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last position of consecutive runs of these lengths."""
    end = np.cumsum(lengths)
    return end - lengths, end


def sums_by_run(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    begin, end = ends_of(lengths)
    return total[end] - total[begin]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def window_hashes(words: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; shorter by size - 1."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, U)
    for j in range(size):
        h = h * U(seed) + words[j : j + n]
    return mixed(h)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def share_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when Python ends.

    One is made up only where Spark runs on this machine alone, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    folder = f"{root}/llm-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Written to the shared folder and read back: results survive lost executors."""
    path = f"{share_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which a driver with little to do puts
    off for half an hour; after a table as large as the corpus was written, that is late.
    The first collection leaves the query that ran last; the second finds it."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
