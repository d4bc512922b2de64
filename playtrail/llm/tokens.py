"""Token counts by a digest cache.

A text's key is the SHA-256 of its normalised content (null: empty; otherwise the bytes as
they are, since any other change could change the count) with the digest of the tokenizer
file.  Stored counts are joined to the keys; one copy of each text without count is encoded
and its count appended to the cache, a Parquet table that any later run can read.

Most of the time is the tokenizer's, so a task gives it as little as it can: where the
tokenizer always cuts at a single space, a text's count is that of its pieces between such
spaces, and the task has each piece encoded once while it knows fewer than ``PIECES``.

* The cache may hold a key twice (two runs at once, a retried append); one count is read.
* Repeated rows and repeated texts get the same count; a null or empty text has 0 tokens.
* Extra columns stay; result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import over, slices, whole_rows

RESULTS = ["n_bytes", "n_tokens", "over_limit"]
SCHEMA = "digest string, tokenizer string, n_tokens long"
#: Pieces that a task knows the counts of at most, and their characters; others are encoded each time.
PIECES, PIECE_CHARS = 250_000, 32
_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark, path: str) -> DataFrame:
    """The cache's rows, one for each key; an empty frame where nothing was written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("digest", "tokenizer").agg(F.min("n_tokens").alias("n_tokens"))


def cuts_at_spaces(model: bytes) -> bool:
    """Whether this tokenizer begins a word at each single space between two characters that
    are no white space: texts stay as they are, words are split by GPT-2's pattern, merges
    stay inside words and no added token holds or takes in white space."""
    file = json.loads(model)
    split, merges = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and merges.get("type") == "BPE"
        and not merges.get("dropout")
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
            for t in file.get("added_tokens") or []
        )
    )


def pieces_of(text: str) -> list[str]:
    """The text cut at single spaces between two characters that are no white space."""
    pieces = text.split(" ")
    if "" in pieces or pieces != list(map(str.strip, pieces)):
        return _CUT.split(text)
    return pieces


def counter(encode: Callable[[list[str]], list], model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of texts; ``encode`` gives an encoding for each of several texts."""
    if not cuts_at_spaces(model):
        return lambda texts: list(map(len, encode(texts)))
    known: dict[str, int] = {}

    def count(text: str) -> int:
        first, *rest = pieces_of(text)
        new = list(set(rest).difference(known))
        n, *found = map(len, encode([first, *(" " + p for p in new)]))
        here = dict(zip(new, found))
        n += sum(here[p] if p in here else known[p] for p in rest)
        if len(known) < PIECES:
            known.update((p, k) for p, k in here.items() if len(p) <= PIECE_CHARS)
        return n

    return lambda texts: list(map(count, texts))


def encoded(misses: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Counts of texts, by the tokenizer's library; rows are ``digest, text``.

    The file is shipped with the job, so executors need no copy of their own."""
    with open(tokenizer_path, "rb") as file:
        model = misses.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(model.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        counts_of = counter(lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False), model.value)
        seen: set[str] = set()
        for batch, texts in slices(batches, "text"):
            new = {}
            for digest, text in zip(batch.column(batch.schema.get_field_index("digest")).to_pylist(), texts):
                if digest not in seen:
                    new[digest] = text.decode()
            seen.update(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(new), pa.string()),
                    pa.array([version] * len(new), pa.string()),
                    pa.array(counts_of(list(new.values())), pa.int64()),
                ],
                names=["digest", "tokenizer", "n_tokens"],
            )

    return misses.mapInArrow(count, SCHEMA)


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 1024, id: str = "doc_id"
) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit``; appends new counts to the cache."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col(id).cast("string").alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    cache = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # One row holds a digest's text; only keys are grouped, so copies combine before they move.
    # A merge join brings rows that repeat with their id together; the first is encoded.
    owners = keyed.groupBy("digest").agg(F.min("id").alias("owner")).join(cache, "digest", "left_anti")
    misses = keyed.join(
        owners.withColumnRenamed("digest", "own_digest").hint("merge"),
        (F.col("digest") == F.col("own_digest")) & F.col("id").eqNullSafe(F.col("owner")),
        "left_semi",
    )
    encoded(misses.select("digest", "text"), tokenizer_path, version).write.mode("append").parquet(cache_path)

    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    own = F.coalesce(F.col("row.text"), F.lit(""))
    rows = whole_rows(docs).select(
        "row", F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("digest")
    )
    return over(rows.join(counts, "digest").withColumn("over_limit", F.col("n_tokens") > limit), RESULTS)
