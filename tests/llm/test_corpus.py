"""Substrings, Jaccard components, language model: against brute force."""

import gc
import math
import random
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtrail.llm import language_model
from playtrail.llm.common import fold, stored
from playtrail.llm.components import components
from playtrail.llm.jaccard import jaccard_components
from playtrail.llm.language_model import counted, pair_hashes, score_texts, word_hashes
from playtrail.llm.packed import corpus_counts, counts_for, in_chunks, sent, unpack
from playtrail.llm.substrings import SuffixAutomaton, remove_repeats, repeated_spans
from tests.llm.helpers import LOWER, empty, frame, odd_texts


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts(2)).cache()


def cut(rows, window):
    words = [(t or "").encode().split() for t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window,hot", [(35, 1024), (35, 2), (6, 1024), (6, 1)])
def test_substrings(docs, window, hot):
    found = remove_repeats(docs, window, hot).collect()
    want = cut([r["text"] for r in found], window)
    for r, (n, removed, kept) in zip(found, want):
        assert (r["n_words"], r["n_removed"]) == (n, removed)
        assert b" ".join((r["kept"] or "").encode().split()) == kept
        assert removed or r["kept"] == r["text"]
    assert len(found) == docs.count()


def test_automaton_counts_each_place():
    a = list("xabcdey")
    spans = repeated_spans([(1, a), (1, list("zabcdew")), (2, list("qqqqqq"))], 3)
    assert spans == [[(1, 6)], [(1, 6)], [(0, 6)]]
    automaton = SuffixAutomaton()
    automaton.add(a)
    assert [end for end, _ in automaton.matches(list("ccdeyab"), 3)] == [4, 5]


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(docs, block):
    found = jaccard_components(docs, block=block).collect()
    assert len(found) == docs.count()
    want = linked({r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert any(r["doc_id"] != r["component_id"] for r in found)


def test_jaccard_chain_across_blocks(spark):
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(60)]  # each links with the next ones only
    found = jaccard_components(frame(spark, texts), block=4).where("doc_id IS NOT NULL").collect()
    want = linked({i: shingles(t) for i, t in enumerate(texts)})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_components_of_long_path(spark):
    edges = spark.range(500).selectExpr("id AS a", "id + 1 AS b").union(spark.range(3).selectExpr("1000 + id", "1001 + id"))
    found = components(edges.repartition(7)).groupBy("component").count().collect()
    assert {(r[0], r[1]) for r in found} == {(0, 501), (1000, 4)}


def test_language_model(docs):
    found = score_texts(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 6).collect()
    tokens = {}
    count = Counter()
    for r in docs.collect():
        tokens[r["doc_id"]] = w = (r["text"] or "").encode().translate(LOWER).split() + [None]
        if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for r in found:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert len(found) == docs.count()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 and r["n_tokens"] > 30]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pairs_with_equal_low_bits_are_counted_apart(spark):
    texts = [f"w{i} w{j}" for i in range(1000) for j in range(1000)]
    hashes = pair_hashes(*word_hashes(texts)).reshape(-1, 3)[:, 1]
    low = (hashes & np.uint64(0xFFFFFFFF)) | ((hashes >> np.uint64(32)) % np.uint64(8) << np.uint64(32))
    order = np.argsort(low, kind="stable")
    (equal,) = np.nonzero(np.diff(low[order]) == 0)
    assert len(equal)
    seen, unseen = (texts[order[equal[0] + k]] for k in (0, 1))
    rows = spark.createDataFrame([(1, seen, 0), (2, unseen, 2)], "doc_id long, text string, part int")
    pairs = {r["doc_id"]: unpack(r["pairs"]).tolist() for r in counted(rows).collect()}
    assert pairs[1][1] == 1 and pairs[2][1] == 0


def test_keys_are_gone_before_texts_meet_their_counts(spark, tmp_path, monkeypatch):
    """Shuffle files left by the time the counts are stored: texts and answers, not keys too."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).withColumn("part", F.lit(0))
    folders = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())]

    def shuffled():
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(2)
        return {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}

    before, left, text = shuffled(), [], sum(len(t) for _, t in rows)

    def stored_and_seen(df, *args, **kwargs):
        out = stored(df, *args, **kwargs)
        found = {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}
        left.append(sum(n for f, n in found.items() if f not in before) / text)
        return out

    monkeypatch.setattr(language_model, "stored", stored_and_seen)
    found = counted(docs).collect()
    assert len(found) == len(rows) and all(r["n_known"] == r["n_tokens"] == 401 for r in found)
    assert left[-1] < 1.6, left


def test_a_changed_chunk_is_an_error():
    """Answers to a chunk fit that chunk alone: other keys or other counts don't pass."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    counts = np.stack([np.arange(1000) % 3, np.arange(1000) % 2])
    rows = sent(7, keys, counts, 8, None)

    class Rows:
        groupBy = lambda self, column: self

        def applyInArrow(self, f, schema):
            buckets = rows.column("bucket").to_pylist()
            return pa.concat_tables(f(rows.slice(i, 1)) for i in range(len(buckets)))

    answers = corpus_counts(Rows(), sums=2, steps=True)
    total, owned = counts_for(keys, counts, answers, 8, steps=True)
    assert (total == counts).all() and owned.all()
    other = counts[::-1]
    less = keys[keys >> np.uint64(32) & np.uint64(7) != 3]
    for k, c in ((keys ^ np.uint64(1), counts), (keys, other), (keys[:-1], counts[:, :-1]), (less, counts[:, : len(less)])):
        with pytest.raises(ValueError):
            counts_for(k, c, answers, 8, steps=True)


def test_empty_tables(spark):
    none = empty(spark)
    assert remove_repeats(none).count() == 0
    assert jaccard_components(none).count() == 0
    assert score_texts(none, F.lit(True), F.lit(False)).count() == 0
    untaught = score_texts(frame(spark, ["a b"]), F.lit(False), F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) for r in untaught)


def test_a_worker_stays_small():
    """A chunk's peak is bounded by its bytes, and what it took is given back."""
    code = f"""
import random, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
import numpy as np, pyarrow as pa
from playtrail.llm import substrings
from playtrail.llm.common import release_memory
from playtrail.llm.packed import CHUNK_BYTES, distinct, sent

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096

def peak():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM")) * 1024

rng = random.Random(1)
words = [f"word{{i}}" for i in range(50_000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(CHUNK_BYTES // 3900)]
row = pa.StructArray.from_arrays([pa.array(texts)], ["text"])
table = pa.table({{"row": row, "chunk": pa.array(np.zeros(len(texts), np.int64))}})
del texts, row, words
before = resident()
open("/proc/self/clear_refs", "w").write("5")  # the peak so far was that of making texts
peaks = []
for _ in range(3):
    chunk = substrings.Chunk(table, 35)
    out = sent(0, *distinct(chunk.anchor), 60)
    peaks.append(peak() - before)
    del chunk, out
    release_memory()
print(max(peaks) / CHUNK_BYTES, (resident() - before) / CHUNK_BYTES)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    peak, kept = map(float, done.stdout.split())
    assert peak < 18 and kept < 2


def test_equal_rows_part(spark):
    """Rows that are a third of the table are no larger a group than others."""
    docs = spark.range(9_000).selectExpr("IF(id % 3 = 0, 0, id) AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id)) AS text")
    sizes = [r["count"] for r in in_chunks(docs, 64).groupBy("chunk").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 9_000 / 64


def test_scores_and_weights_equal_plain_loops(docs):
    """Deletion estimates, EM by bucket and the sum of logarithms, token by token."""
    rows = docs.collect()

    def part(r):
        k = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7
        return 2 if k == 2 else 1 if k == 6 else 0

    tokens = [((r["text"] or "").encode().translate(LOWER).split() + [None], part(r)) for r in rows]

    def counts(parts):
        word, pair, texts = Counter(), Counter(), 0
        for w, p in tokens:
            if p in parts:
                word.update(w)
                pair.update(zip([None, *w], w))
                texts += 1
        return word, pair, texts

    def estimates(w, word, pair, texts, total):
        for before, x in zip([None, *w], w):
            context = texts if before is None else word[before]
            yield context.bit_length(), pair[before, x] / max(context, 1), word[x] / total

    everything, main = counts((0, 1)), counts((0,))
    uniform = 1 / (len(everything[0]) + 1)
    cells = Counter()
    for w, p in tokens:
        if p == 1:
            for b, by_pair, by_word in estimates(w, *main, sum(main[0].values())):
                step = [0 if x == 0 else round(-math.log2(x) * 8) for x in (by_pair, by_word)]
                cells[b, *(None if x == 0 else s for x, s in zip((by_pair, by_word), step))] += 1
    weights = {b: [0.5, 0.4, 0.1] for b in range(64)}
    for _ in range(50):
        gained = {b: [0.01, 0.1, 1.0] for b in weights}
        for (b, *steps), n in cells.items():
            parts = [0 if s is None else 2.0 ** (-s / 8) for s in steps] + [uniform]
            share = [w * x for w, x in zip(weights[b], parts)]
            for k, x in enumerate(share):
                gained[b][k] += n * x / sum(share)
        weights = {b: [x / sum(g) for x in g] for b, g in gained.items()}
    want = Counter()
    for r, (w, _) in zip(rows, tokens):
        logs = (
            math.log10(sum(a * x for a, x in zip(weights[b], (by_pair, by_word, uniform))))
            for b, by_pair, by_word in estimates(w, *everything, sum(everything[0].values()))
        )
        want[r["doc_id"], round(sum(logs), 4)] += 1
    found = score_texts(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 6).collect()
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in found) == want
    assert any(p == 1 for _, p in tokens) and len(cells) > 5
