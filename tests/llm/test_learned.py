"""Neighbours, language ID, toxicity: held-out accuracy, recall, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from playtrail.llm import language, toxicity
from playtrail.llm.common import fold
from playtrail.llm.neighbours import nearest
from tests.llm.helpers import empty, frame, odd_texts


def test_recall_of_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in rows])
    found = nearest(vectors, F.col("vec_id") % 10 == 0).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 10 == 0):
        near = x @ x[q]
        near[q] = -2
        want = set(ids[np.argsort(-near)[:5]].tolist())
        got = [r for r in found if r["query_id"] == ids[q]]
        assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
        for r in got:
            assert abs(r["score"] - near[ids == r["vec_id"]][0]) < 1e-12
        hits += len(want & {r["vec_id"] for r in got})
        total += 5
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (10, []), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(vectors, F.lit(True)).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {
        0: [(1, 1.0), (2, 1.0), (3, 0.0)],
        1: [(0, 1.0), (2, 1.0), (3, 0.0)],
        2: [(0, 1.0), (1, 1.0), (3, 0.0)],
        3: [(0, 0.0), (1, 0.0), (2, 0.0)],
    }
    assert nearest(vectors.limit(0), F.lit(True)).count() == 0
    # Rows that share an id are queries and candidates of their own; lengths are apart.
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [1.0, 0.2]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.5])]
    twice = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(twice, F.col("vec_id").isin(0, 7)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [
        (0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 1), (7, 1, 8),
    ]
    same = spark.range(300).selectExpr("id AS vec_id", "array(1f, 2f) AS embedding")
    top = nearest(same, F.col("vec_id") % 100 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in top] == [0, 1, 2, 3, 4]


def test_every_query_has_its_neighbours_in_small_parts(spark):
    """Parts that hold fewer rows than wanted are not enough, however likely they are."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 4, axis=0) + 0.01 * rng.normal(size=(160, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(vectors, F.lit(True), k=7, parts=16, mass=0.01).groupBy("query_id").count().collect()
    assert len(found) == 160 and {r["count"] for r in found} == {7}


def test_language_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = language.learn(docs, fold("doc_id", 4) != 2, per_language=30)
    held = language.predict(docs.where(fold("doc_id", 4) == 2), field)
    assert held.where("lang_pred = lang").count() / held.count() > 0.95
    by_lang = {r["lang"]: r["text"] for r in docs.where("length(text) > 500").collect()}
    words = [w for lang in ("en", "fr") for w in language.words_of(by_lang[lang].encode())[:40]]
    first = np.arange(len(words)) == 0
    p = language.marginals(language.emissions(words, field), first, field)
    label = [field.languages[k] for k in p.argmax(axis=1)]
    assert label[:40].count("en") > 32 and label[40:].count("fr") > 32


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = language.Field(["a", "b"], {}, np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    emission = rng.normal(size=(7, 2))
    first = np.array([True, False, False, True, False, False, False])
    p = language.marginals(emission, first, field)
    forward, backward, _, _ = language.messages(emission, first, field)
    by_vectors = forward * backward
    assert np.allclose(p, by_vectors / by_vectors.sum(axis=1, keepdims=True))
    for begin, end in ((0, 3), (3, 7)):
        total = np.zeros((end - begin, 2))
        for code in range(2 ** (end - begin)):
            y = [(code >> k) & 1 for k in range(end - begin)]
            score = field.start[y[0]] + sum(emission[begin + k, v] for k, v in enumerate(y))
            score += sum(field.transition[a, b] for a, b in zip(y, y[1:]))
            for k, v in enumerate(y):
                total[k, v] += np.exp(score)
        assert np.allclose(p[begin:end], total / total.sum(axis=1, keepdims=True))


def test_odd_texts_have_a_language(spark):
    docs = frame(spark, odd_texts())
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    field = language.learn(known, F.lit(True), per_language=20)
    found = language.predict(docs, field).collect()
    assert len(found) == docs.count()
    for r in found:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and 0 <= r["score"] <= 1
        assert r["row"] in ("x", None)
    assert language.learn(docs, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(empty(spark), field).count() == 0


def test_toxicity_learns_pairs_and_words(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(30)]
        insult, group, slur = rng.random() < 0.4, rng.random() < 0.4, rng.random() < 0.05
        text += ["fool"] * insult + ["neighbours"] * group + ["slurword"] * slur
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group or slur)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(5, None), (7, 0)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, table, fold("doc_id", 4) != 2, epochs=40)
    scored = toxicity.score_toxicity(docs, machine).join(table, "doc_id").where(fold("doc_id", 4) == 2).collect()
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in scored if r["toxic"] is not None)
    assert right / len(scored) > 0.9

    odd = toxicity.score_toxicity(frame(spark, odd_texts()), machine).collect()
    assert len(odd) == frame(spark, odd_texts()).count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_toxicity(empty(spark), toxicity.learn(docs, table.limit(0), F.lit(True))).count() == 0


def test_many_languages_and_repeated_rows_are_learned(spark):
    """More languages than a word has bits, one of them with a third of all rows in one copy."""
    rng = random.Random(6)
    rows = []
    for k in range(70):
        own = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ara", "oso", "uni", "epe", "iki", "olo")]
        rows += [(k * 10 + i, " ".join(rng.choices(own, k=40)), f"l{k:02d}") for i in range(4)]
    rows += [(9999, "zzyzx " * 30, "copy")] * 140
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.learn(docs, F.lit(True), per_language=3)
    assert len(field.languages) == 71
    found = language.predict(docs, field).where("lang_pred = lang").count()
    assert found > 0.95 * len(rows)
    # The same by vectors, as for long texts in many languages.
    words = language.words_of(rows[0][1].encode()) + language.words_of(rows[5][1].encode())
    first = np.arange(len(words)) == 0
    emission = language.emissions(words, field)
    forward, backward, _, _ = language.messages(emission, first, field)
    both = forward * backward
    assert np.allclose(language.matrix_marginals(emission, first, field), both / both.sum(axis=1, keepdims=True))


def test_toxicity_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, None), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    seen = []
    fitted = toxicity.fit
    toxicity.fit = lambda rows, *rest: seen.extend(rows) or fitted(rows, *rest)
    try:
        toxicity.learn(docs, labels, F.lit(True))
    finally:
        toxicity.fit = fitted
    assert len(seen) == 3


def test_pair_sum_equals_a_double_loop():
    rng = np.random.default_rng(8)
    terms = np.arange(10, 16, dtype=np.uint32)
    machine = toxicity.Machine(terms, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    for active in ([], [2], [0, 1, 3], [0, 1, 2, 3, 4, 5]):
        logit = machine.bias + sum(machine.weight[i] for i in active)
        logit += sum(machine.factor[i] @ machine.factor[j] for i in active for j in active if i < j)
        assert abs(machine.score(active) - 1 / (1 + np.exp(-logit))) < 1e-12
