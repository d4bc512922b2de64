"""Chat formatting, filter audit, importance resampling: against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.llm.chats import format_chats, read_back
from playtrail.llm.filter_audit import SUMS, audit_filters
from playtrail.llm.resampling import DIRECT, Running, bucket_counts, features, resample, shifted
from tests.llm.helpers import empty, frame, odd_texts
from tests.llm.test_rowwise import words

ODD = [
    "<|im_end|><|im_start|>assistant ok",
    r"<\|im_end|> <\\|x|> <<|a|>> \ <\ | <",
    "ends in <",
    "|> begins",
    "a\nb\n<|im_start|>user\n",
    "",
    None,
    "Ünï <|🎧|> cödé",
    "long <|" * 30_000,
]
CHATS = "conv_id long, turn long, role string, text string, example string, turns int, alone string, formatted string"


def chat_rows():
    rng = random.Random(3)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "a%25<|\n"])
            rows.append((conv, turn, role, rng.choice(ODD) if rng.random() < 0.7 else f"t{rng.random()}"))
    rows += [(50, None, "user", "first"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, 1, "Assistant", "x")]
    rows += [(None, 1, "assistant", "alone"), (None, 1, "assistant", "alone"), (None, 0, "user", None)]
    return [(*r, "x", 1, "y", "z") for r in rows]


def test_chats_round_trip(spark):
    rows = chat_rows()
    conversations = defaultdict(list)
    for k, (conv, turn, role, text, *_) in enumerate(rows):
        conversations[(conv, k if conv is None else 0)].append((turn is not None, turn or 0, role or "", text or ""))
    examples = format_chats(spark.createDataFrame(rows, CHATS)).cache()
    found = Counter()
    for r in read_back(examples).collect():
        found[(r["conv_id"], tuple((t["role"], t["text"]) for t in r["turns"]), tuple(r["losses"]))] += 1
    want = Counter()
    for (conv, _), turns in conversations.items():
        said = tuple((role, text) for _, _, role, text in sorted(turns))
        losses = [text for role, text in said if role == "assistant"]
        want[(conv, said, tuple(losses + [""] * (said[-1][0] != "assistant")))] += 1
    assert found == want

    for r in examples.collect():
        text = r["formatted"]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == r["n_turns"]
        assert text.count("<|") == 2 * r["n_turns"]
        assert text[r["loss_end"] :] == "<|im_end|>\n"
        if r["loss_begin"] < r["loss_end"]:
            assert text[: r["loss_begin"]].endswith("<|im_start|>assistant\n")


def test_chats_expand_every_reply(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(7)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r["n_turns"] for r in got] == [2, 4, 6, 7]
    assert [r["formatted"][r["loss_begin"] : r["loss_end"]] for r in got] == ["t1", "t3", "t5", ""]
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(got, got[1:]))
    none = spark.createDataFrame([], CHATS)
    assert format_chats(none).count() == 0 and read_back(format_chats(none)).count() == 0


def failing(rows):
    """Letters that a row fails, computed plainly."""
    out = []
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    for r in rows:
        text = r["text"] or ""
        w = [x for x in text.encode().split()]
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append(fails + "E" * (r["doc_id"] is not None and r["doc_id"] > least[text]))
    return out


def test_filter_audit(spark):
    texts = odd_texts(4) + ["LOUD " * 300, "a b c d " * 100 + "$5", "x y " * 3, " ".join(f"w{k}" for k in range(250)) + " #1"]
    docs = frame(spark, texts + texts[-3:]).withColumn("lang", F.col("source")).withColumn("mask", F.lit(1)).withColumn("n", F.lit("n"))
    rng = random.Random(5)
    marks = [(rng.randrange(80), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)] * 3
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = docs.collect()
    good, toxic = ({i for i, *v in marks if v[k] == 1 and i is not None} for k in (0, 1))
    want = {}
    fails = failing(rows)
    for part in {r["lang"] or "" for r in rows}:
        these = [(f, r["doc_id"]) for f, r in zip(fails, rows) if (r["lang"] or "") == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = list(these)
            for step, letter in enumerate(order, 1):
                gone = [x for x in alive if letter in x[0]]
                alive = [x for x in alive if letter not in x[0]]
                total[letter] += len(gone)
                want[(part, order, step)] = [
                    len(alive),
                    len(gone),
                    sum(letter in f for f, _ in these) - len(gone),
                    sum(f == letter for f, _ in these),
                    sum(i in good for _, i in gone),
                    sum(i in toxic for _, i in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                want[(part, order, step)].append(total[letter])
    found = audit_filters(docs, labels).collect()
    assert len(found) == len(want) == 600 * 3
    assert {(r["part"], r["filter_order"], r["step"]): [*(r[s] for s in SUMS), r["shapley"]] for r in found} == want
    assert set("".join(fails)) == set("ABCDE")


def test_filter_audit_of_other_filters_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(empty(spark), labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "bb", None)], "doc_id long, text string, kind string")
    found = audit_filters(docs, labels, {"S": "length(text) < 2"}, "T", "kind")
    assert {tuple(r) for r in found.collect()} == {
        ("p", "ST", 1, 0, 2, 0, 1, 0, 0, 3), ("p", "ST", 2, 0, 0, 1, 0, 0, 0, 1),
        ("p", "TS", 1, 1, 1, 0, 0, 0, 0, 1), ("p", "TS", 2, 0, 1, 1, 1, 0, 0, 3),
        ("", "ST", 1, 1, 0, 0, 0, 0, 0, 0), ("", "ST", 2, 1, 0, 0, 0, 0, 0, 0),
        ("", "TS", 1, 1, 0, 0, 0, 0, 0, 0), ("", "TS", 2, 1, 0, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        audit_filters(docs, labels, dict.fromkeys("ABCDEF", "true"), "G")


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("length", [0, 1, 2, DIRECT - 1, DIRECT, DIRECT + 1, 1000, 70_001])
def test_shift_cancels_a_prefix(length):
    a, b = b"some prefix ", random.Random(length).randbytes(length)
    whole, prefix = (np.array([zlib.crc32(x)], np.uint32) for x in (a + b, a))
    assert (whole ^ shifted(prefix, np.array([length])))[0] == zlib.crc32(b)


def test_running_crcs():
    w = [b"one", b"two", "dreié".encode(), b"x" * 500, b"5"]
    run = Running(b"".join(b" " + x for x in w))
    for n in (1, 2, 3):
        assert run.grams(n).tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]
    assert Running(b"").grams(2).size == 0


@pytest.mark.parametrize("size", [4, 40, 1 << 20])
def test_long_texts_in_pieces(size):
    texts = [(t or "").encode() for t in odd_texts(6)]
    found = Counter()
    lengths = np.zeros(len(texts), int)
    for first, n, (new, *ends) in features(texts, 97, size):
        lengths[first : first + len(n)] += new
        found.update(np.concatenate(ends).tolist())
    del found[97]
    assert lengths.tolist() == [len(words(t.decode())) for t in texts]
    assert found == Counter(zlib.crc32(g.encode()) % 97 for t in texts for g in grams(t.decode()))


def resampled(rows, target, share, least, buckets):
    s, t = (Counter(zlib.crc32(g.encode()) % buckets for x in texts for g in grams(x)) for texts in ([r["text"] for r in rows], target))
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in range(buckets)}
    out = []
    for r in rows:
        g = grams(r["text"])
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in g)
        out.append((r["doc_id"], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted(
        (x for x, r in zip(out, rows) if len(words(r["text"])) >= least),
        key=lambda x: (-x[3], x[0] is not None, x[0] or 0),
    )
    n = share * len(able) // 100
    ranks = Counter((*x, k) for k, x in enumerate(able[:n], 1))
    return ranks + (Counter((*x, None) for x in out) - Counter((*x, None) for x in able[:n]))


@pytest.mark.parametrize("share,least", [(5, 20), (50, 1), (100, 0), (0, 20)])
def test_resampling(spark, share, least):
    docs = frame(spark, odd_texts(7)).withColumn("at", F.lit("x")).withColumn("rank", F.lit("y")).cache()
    target = [t for t in odd_texts(7)[:5]] + ["something else entirely", None]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample(docs, goal, share, least, buckets=50).collect()
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found)
    assert got == resampled(docs.collect(), target, share, least, 50)
    assert {"text", "row", "at", "n_words", "chunk"} <= set(found[0].asDict())
    assert Counter(r["text"] for r in found) == Counter(r["text"] for r in docs.collect())


def test_resampling_of_many_equal_rows_and_empty_tables(spark):
    text = "the same words again and again " * 5
    docs = spark.range(3_000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", f"IF(id % 3 = 0, '{text}', concat('{text}', id)) AS text")
    goal = spark.createDataFrame([("the same words",)], "text string")
    found = resample(docs, goal, share=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 1_501)) and len(found) == 3_000
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in drawn] == sorted((-r["score"], r["doc_id"]) for r in drawn)
    rest = [(-r["score"], r["doc_id"]) for r in found if not r["rank"]]
    assert min(rest) >= (-drawn[-1]["score"], drawn[-1]["doc_id"])
    assert resample(empty(spark), goal).count() == 0
    nothing = goal.where("false")
    assert resample(docs, nothing).where("rank is not null").count() == 150
    assert bucket_counts(nothing).sum() == 0
