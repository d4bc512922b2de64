"""Mixing, decontamination, tokens, licenses: against direct computations."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from playtrail.llm.decontamination import decontaminate
from playtrail.llm.licenses import NOTICES, PHRASES, scan_licenses
from playtrail.llm.mixing import mix_sources
from playtrail.llm.tokens import count_tokens, counter, cuts_at_spaces
from tests.llm.helpers import empty, frame, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts()).cache()


def test_mixing_rates_and_copies(docs):
    rows = docs.collect()
    weights = {"s0": 20.0, "s1": 0.0}
    out = mix_sources(docs, weights, default_weight=1.0).collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    share = {"s0": 20 / 21, "s1": 0, None: 1 / 21}
    copies = defaultdict(list)
    for r in out:
        copies[r["doc_id"]].append(r)
        assert math.isclose(r["rate"], share[r["source"]] * sum(size.values()) / size[r["source"]])
    assert not any(r["source"] == "s1" for r in out)
    repeated = Counter(r["doc_id"] for r in rows)
    for i, rs in copies.items():
        assert Counter(r["copy"] for r in rs) == {k: repeated[i] for k in range(1, len(rs) // repeated[i] + 1)}
    places = [r["doc_id"] if r["doc_id"] is not None else -1 for r in out]
    assert places != sorted(places)  # shuffled
    assert len({r["shuffle_key"] for r in out}) == len({(r["doc_id"], r["copy"]) for r in out})
    assert {"text", "row", "chunk", "rate", "copy"} <= set(out[0].asDict())


def test_poisson_distribution(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END AS source", "'x' AS text")
    out = mix_sources(docs, {"a": 9.0}).groupBy("source", "doc_id").count().collect()
    counts = [r["count"] for r in out if r["source"] == "a"]
    rate = 0.9 * 20_000 / 2_000
    counts += [0] * (2_000 - len(counts))
    mean = sum(counts) / len(counts)
    variance = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - rate) < 0.3 and abs(variance - rate) < 1.2


@pytest.mark.parametrize("window,block", [(10, 100_000), (10, 7), (4, 5), (1, 100_000)])
def test_decontamination(spark, docs, window, block):
    texts = [r["text"] for r in docs.collect()]
    items = [(k, " ".join(words(t)[5:45])) for k, t in enumerate(texts[:30])]
    items += [(100, "a b"), (101, "One TWO, three"), (102, None), (103, ""), (None, "x"), (100, "a b"), (104, "a a a a a a a a a a a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(docs, benchmark, window, block).collect()
    cuts = {}
    for k, t in items:
        w = words(t)
        if w and k is not None:
            for i in range(max(1, len(w) - window + 1)):
                cuts.setdefault(tuple(w[i : i + window]), set()).add(str(k))
    assert len(found) == len(texts)
    for r in found:
        w, hit, names = words(r["text"]), set(), set()
        for n in {len(c) for c in cuts}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in cuts:
                    hit.update(range(i, i + n))
                    names |= cuts[tuple(w[i : i + n])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(names))


def test_tokens(docs, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tables = pytest.importorskip("public_tokenizers")
    path, cache = tables.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    model = tokenizers.Tokenizer.from_file(path)
    first = count_tokens(docs, cache, path).collect()
    for r in first:
        text = r["text"] or ""
        n = len(model.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    spark = docs.sparkSession
    distinct = len({r["text"] or "" for r in docs.collect()})
    assert spark.read.parquet(cache).count() == distinct
    assert sorted(map(str, count_tokens(docs, cache, path).collect())) == sorted(map(str, first))
    assert spark.read.parquet(cache).count() == distinct  # nothing was encoded again


def test_repeated_pieces_are_encoded_once():
    """The library gets each piece once, and its counts are those of whole texts."""
    tokenizers = pytest.importorskip("tokenizers")
    tables = pytest.importorskip("public_tokenizers")
    path = tables.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        model = file.read()
    tokenizer, given = tokenizers.Tokenizer.from_file(path), []

    def encode(texts):
        given.extend(texts)
        return tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    rng = random.Random(4)
    vocabulary = [f"word{i}," for i in range(50)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(50)]
    assert counter(encode, model)(texts) == [len(e) for e in tokenizer.encode_batch_fast(texts)]
    assert sum(map(len, given)) < sum(map(len, texts)) / 10

    # Every character of the first plane beside a single space, and runs of all kinds of white space.
    texts = [f"x{chr(c)} y {chr(c)}z {chr(c)} '{chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    kinds = ["a", "7", "é", "中", "'s", "'ll", "!?", "<|endoftext|>", "<|endof", "😀", "\u0301", "x" * 40]
    kinds += [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u200b", "\x1c", "\x85", "\0"]
    texts += ["".join(rng.choices(kinds, k=rng.randint(0, 30))) for _ in range(20_000)]
    assert counter(encode, model)(texts) == [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts():
    tables = pytest.importorskip("public_tokenizers")
    with open(tables.path("byte_bpe_50k.json"), "rb") as file:
        model = json.load(file)
    assert cuts_at_spaces(json.dumps(model).encode())
    token = model["added_tokens"][0]
    for change in (
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "Metaspace"}},
        {"pre_tokenizer": None},
        {"pre_tokenizer": {**model["pre_tokenizer"], "add_prefix_space": True}},
        {"pre_tokenizer": {**model["pre_tokenizer"], "use_regex": False}},
        {"model": {**model["model"], "dropout": 0.1}},
        {"model": {"type": "Unigram"}},
        {"added_tokens": [{**token, "content": "of the"}]},
        {"added_tokens": [{**token, "lstrip": True}]},
    ):
        other, given = json.dumps(model | change).encode(), []
        assert counter(lambda texts: given.extend(texts) or texts, other)(["a b", "c"]) == [3, 1]
        assert given == ["a b", "c"]


def test_licenses(spark):
    texts = [
        "CC-BY and cc by cc by. General Public License; all rights reserved",
        "Licenced undr the Apache License, Version 2.0!",
        "permission is herby granted free of charge, to any persn",
        "cc bye", "accby", "", None, "all rights reserved " * 50, "é all rights reserved",
    ]
    rows = {r["doc_id"]: r for r in scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert r["first_word"] == min((k for k, _ in at), default=None)
        assert r["last_word"] == max((k for k, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not at
        assert 0 <= r["score"] <= 1
    assert rows[1]["labels"] == "apache-2.0" and rows[1]["spans"][0]["edits"] == 2
    assert rows[2]["labels"] == "mit"
    assert rows[5]["labels"] == "" and rows[6]["score"] == 0


def test_empty_tables(spark, tmp_path):
    tables = pytest.importorskip("public_tokenizers")
    none = empty(spark)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert mix_sources(none, {}).count() == 0
    assert decontaminate(none, benchmark).count() == 0
    assert decontaminate(frame(spark, ["a b"]), benchmark).where("n_hit > 0").count() == 0
    assert count_tokens(none, str(tmp_path / "c"), tables.path("byte_bpe_50k.json")).count() == 0
    assert scan_licenses(none).count() == 0


def nearest_edits(pattern, text):
    """Least edits between the pattern and any stretch of the text: one row of edits an end."""
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != p)))
        row = new
        least = min(least, row[-1])
    return least


def test_fuzzy_notices_equal_edit_distances(spark):
    """A label is found exactly where some stretch of the text is near enough."""
    rng = random.Random(9)
    texts = []
    for k in range(120):
        phrase = list(rng.choice(NOTICES)[0])
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(phrase))
            kind = rng.random()
            if kind < 0.4:
                phrase[at] = rng.choice("abcdexyz ")
            elif kind < 0.7:
                del phrase[at]
            else:
                phrase.insert(at, rng.choice("abcdexyz "))
        filler = lambda: " ".join(rng.choices(["lorem", "public", "license", "rights", "free", "gnu"], k=rng.randint(0, 8)))
        texts.append(f"{filler()} {''.join(phrase)} {filler()}")
    found = scan_licenses(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    near = far = 0
    for r in found:
        text = " " + " ".join(words(texts[r["doc_id"]])) + " "
        want = {label for phrase, label, k in NOTICES if nearest_edits(phrase, text) <= k}
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == want | base
        near, far = near + bool(want), far + (not want)
        split = text.split()
        for s in r["spans"]:
            phrase, most = next((p, k) for p, label, k in NOTICES if label == s["label"] and nearest_edits(p, text) <= k)
            stretch = " ".join(split[s["first_word"] : s["last_word"] + 1])
            assert 0 <= s["edits"] <= max(k for *_, k in NOTICES)
            assert nearest_edits(phrase, f" {stretch} ") <= most or s["label"] in ("gpl", "mit")
    assert near > 20 and far > 5
