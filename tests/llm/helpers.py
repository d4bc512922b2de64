"""Fixtures of the operators' tests: small texts with every odd case, and brute force."""

import random

from pyspark.sql import types as T

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns whose names operators use themselves.
        T.StructField("row", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("chunk", T.IntegerType()),
    ]
)


def odd_texts(seed: int = 1) -> list[str | None]:
    """Random, repeated, nearly equal, very long, empty and null texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(50)]
    base = [rng.choice(words) for _ in range(120)]
    near = [list(base) for _ in range(8)]
    for k, text in enumerate(near):
        for _ in range(k):
            text[rng.randrange(len(text))] = f"edit{rng.random()}"
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(20)]
    texts += [" ".join(t) for t in near] + [" ".join(base)] * 5
    texts += [" ".join([rng.choice(words) for _ in range(30)] + passage + [rng.choice(words) for _ in range(30)]) for _ in range(4)]
    texts += [" ".join(rng.choice(words) for _ in range(20_000)), "a " * 300, "a b " * 100, "x", "One  TWO\tthree\nfour", "One two"]
    texts += [None, None, "", " \n ", "!!! ###", "12 34", "Ünï cödé " * 20, "one two three four five", "ONE two three four FIVE"]
    return texts


def frame(spark, texts, sources=("s0", "s1", None)):
    rows = [
        (i, t, None, sources[i % len(sources)], len(t or ""), "x", "y", i, i) for i, t in enumerate(texts)
    ]
    rows += [rows[0], rows[0], (None, "no id at all", None, None, 12, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
