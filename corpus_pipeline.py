"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again
as the next one's docs.  All but the last return the columns of their docs, extra ones too.

* ``language``: texts without a letter, and those whose words have no likely language, go;
  texts in several languages stay.  Where no row has a language to learn, only the former go.
* ``near_duplicates``: of each group of linked rows the one with the smallest id stays (no id
  is the largest), whatever other rows have its id; of rows equal in all columns, one.
* ``repeated_passages``: words in runs that occur elsewhere too are cut out; ``n_chars``
  follows the text.
* ``benchmark_passages``: documents that hold a passage of the benchmark go.
* ``mixture``: documents are repeated by their source's rate and shuffled.

Null and empty texts go in the first stage; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.llm import language
from playtrail.llm.common import fold, stored
from playtrail.llm.decontamination import decontaminate
from playtrail.llm.jaccard import jaccard_components
from playtrail.llm.mixing import mix_sources
from playtrail.llm.queries import WEIGHTS
from playtrail.llm.substrings import remove_repeats

#: The likeliest languages of a text's words, each word's own, must have this mean probability.
LEAST_LANGUAGE_SCORE = 0.4


def apart(docs: DataFrame) -> DataFrame:
    """``rest`` (all columns but the text) and ``text``: nothing clashes with a result."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"), "text")


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = language.learn(docs, fold("doc_id", 4) != 2)
    if field is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = language.predict(apart(docs), field, sure="sure")
    return together(found.where((F.col("lang_pred") != "und") & (F.col("sure") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = [F.col("text") if c == "text" else F.col("rest").getField(c) for c in docs.columns]
    # A hash passes over nulls, so where they are is hashed too; 64 bits name a row among its
    # near duplicates, 128 tell whether it is the same row.
    hashed = [*parts, *(p.isNull() for p in parts)]
    rows = apart(docs).withColumns({"key": F.xxhash64(*hashed), "check": F.xxhash64(F.lit(1), *hashed)})
    linked = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"))
    components = linked.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    ids = rows.select("key", "check", F.col("rest").getField("doc_id").alias("id")).distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    stays = components.join(ids, "key").groupBy("component").agg(least).select(F.col("least.key").alias("key"))
    stays = ids.select("key", "check").distinct().join(stays, "key")
    once = rows.dropDuplicates(["key", "check"]).join(stays, ["key", "check"], "left_semi")
    return together(once, docs.columns)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = remove_repeats(apart(docs))
    cut = F.col("n_removed") > 0
    kept = together(found.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))), docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def benchmark_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return together(found.where("n_hit = 0"), docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, WEIGHTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeated_passages", repeated_passages_stage),
    ("benchmark_passages", benchmark_passages_stage),
    ("mixture", mixture_stage),
]

#: Learned labels and automata are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
