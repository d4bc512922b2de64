"""Each stage of the pipeline on what its predecessor kept, and the registered queries."""

import pytest

import corpus_pipeline as P
from tests.llm.helpers import empty, frame, odd_texts
from tests.llm.test_corpus import cut, linked, shingles
from tests.llm.test_rowwise import words


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("rest", docs_extra())
    columns = docs.columns
    kept = P.language_stage(spark, docs, sf).cache()
    assert kept.columns == columns
    assert kept.count() >= 0.98 * docs.count()

    one = P.near_duplicates_stage(spark, kept, sf).cache()
    want = linked({r["doc_id"]: shingles(r["text"]) for r in kept.collect()})
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert one.columns == columns and one.count() < kept.count()

    less = P.repeated_passages_stage(spark, one, sf).cache()
    rows = one.collect()
    after = {r["doc_id"]: r for r in less.collect()}
    for r, (_, removed, text) in zip(rows, cut([r["text"] for r in rows], 35)):
        assert after[r["doc_id"]]["text"] == (text.decode() if removed else r["text"])
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
    assert less.columns == columns and len(after) == len(rows)

    clean = P.benchmark_passages_stage(spark, less, sf).cache()
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    ids = {x["doc_id"] for x in clean.select("doc_id").collect()}
    sizes = {len(x) for x in windows}
    for r in less.collect():
        w = words(r["text"])
        held = any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
        assert (r["doc_id"] in ids) == (not held)
    assert ids <= set(after) and clean.columns == columns

    mixed = P.mixture_stage(spark, clean, sf).cache()
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= ids
    rates = {r["source"]: r["rate"] for r in mixed.select("source", "rate").distinct().collect()}
    wanted = sum(rates.get(r["source"], 0) for r in clean.collect())
    assert abs(mixed.count() - wanted) < 5 * wanted**0.5


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_odd_rows_pass(spark, sf):
    docs = frame(spark, odd_texts())
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.collect()
    none = empty(spark)
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_near_duplicates_are_rows_not_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "ABCD")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c + " end"), (None, d), (7, d), (9, "e"), (9, "e"), (9, None), (None, "9")]
    docs = spark.createDataFrame([(i, t, s) for i, t in rows for s in ("s", None)], "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates_stage(spark, docs, sf).collect()]
    assert {x for x in kept if x[1]} - {(None, c), (None, c + " end")} == {(3, a), (5, b), (7, d), (9, "e"), (None, "9")}
    assert sum(x[0] is None and x[1].startswith("C") for x in kept) == 1
    assert len({t for _, t in kept if t}) == len([t for _, t in kept if t])


def test_mixed_and_unlabelled_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    long = {r["lang"]: r["text"].split()[:60] for r in docs.where("length(text) > 800").orderBy("doc_id").collect()}
    assert len(long) >= 3
    switched = " ".join(w for words in long.values() for w in words)
    more = spark.createDataFrame([(-1, switched, None), (-2, "12 34", None)], docs.schema)
    kept = {r["doc_id"] for r in P.language_stage(spark, docs.union(more), sf).collect()}
    assert -1 in kept and -2 not in kept
    unlabelled = more.union(spark.createDataFrame([(-3, None, None)], docs.schema))
    assert [r["doc_id"] for r in P.language_stage(spark, unlabelled, sf).collect()] == [-1]


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


@pytest.mark.parametrize("number", range(1, 14))
def test_query_runs(spark, sf, number):
    import __spark_entry__ as contract
    from checks.compare import connect, difference

    (name,) = [q for q in contract.queries() if q.startswith(f"op{number}_")]
    found = contract.queries()[name](spark, sf)
    sql = contract.oracle_sql().get(name)
    if sql:
        assert difference(found, connect(sf), sql) is None
    else:
        assert found.count() > 0
