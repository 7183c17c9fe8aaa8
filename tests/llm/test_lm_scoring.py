import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import lm_scoring as lm
from tidewheel.llm import log_bilinear as lb
from tidewheel.session import table
from tidewheel.storage import cut


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False


def plain_base(rows):
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i, is_held(i), len(own), sum(c[t] > 0 for t in own), n, pytest.approx(sum(log10((c[t] + 1) / (n + 1 * (v + 1))) for t in own))))
    return out


def got(rows):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.fixture(scope="module")
def small(spark):
    return lm.op7_log_bilinear(spark, "/root/testdata/sf0.01").collect()


def test_base_scores(spark, small):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    assert by_id(got(small)) == by_id(plain_base([tuple(r) for r in docs]))


def test_better_than_the_base_on_held_out_texts(small):
    held = [r for r in small if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in small)


def test_training_gains_over_untrained_weights(spark, small):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", lm.held_out().alias("held_out"), "text")
    plain = {r["doc_id"]: r["score"] for r in lm.scored(docs, rounds=0).collect()}
    held = [r for r in small if r["held_out"]]
    gain = sum(r["score"] - plain[r["doc_id"]] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.02


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", lm.held_out().alias("held_out"), "text")
    again = {r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(7)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-3) for r in small)


def test_scores_by_brute_force(spark, monkeypatch):
    """Scores from the trained weights by summing over all classes for every token."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "a", "of", "cat", "dog", "sat", f"x{rng.randrange(9)}ing", f"y{rng.randrange(9)}er"]) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", lm.held_out().alias("held_out"))
    monkeypatch.setattr(lm, "CHAIN", 300)
    args = {"head": 5, "shared": 3, "rounds": 2, "size": 6}
    found = {r["doc_id"]: r["score"] for r in lm.scored(docs, **args).collect()}
    numbered = cut(lm.numbered(docs), "test")
    words, counts = lm.counted(numbered, 5, 3)
    weights = lm.trained(cut(lm.classified(numbered, words, counts), "test"), counts, 2, 6)
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    name = lambda t: "\n" if t is None else t
    head = sorted(c, key=lambda t: (-c[t], name(t)))[:5]
    of = lambda t: head.index(t) if t in head else 5 + zlib.crc32(name(t)[-2:].encode()) % 3
    n, v = Counter(), Counter()
    for t in c:
        n[of(t)] += c[t]
        v[of(t)] += 1
    for i, text in rows:
        total, before = 0.0, [8, 8]
        for t in tokens(text):
            k = of(t)
            r = weights.one * weights.R[before[0]] + weights.two * weights.R[before[1]]
            scores = (weights.Q @ r + weights.bias).astype(float)
            total += (scores[k] - np.log(np.exp(scores).sum())) / np.log(10)
            total += 0 if k < 5 else log10((c[t] + 1) / (n[k] + v[k] + 1))
            before = [before[1], k]
        assert found[i] == pytest.approx(total, rel=1e-4)


def test_hot_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 10)
    rows = [(None, b"ab")] * 400 + [(i, b"cd") for i in range(50)]
    dealt = lm._dealt(spark.createDataFrame(rows, "doc_id long, classes binary"), 2, 8)
    per = [r["count"] for r in dealt.groupBy("round", "chain").count().collect()]
    assert sum(per) == 450 and len(per) == 16 and max(per) < 80


def test_normalised():
    rng = np.random.default_rng(0)
    frequency = rng.random(20)
    frequency /= frequency.sum()
    weights = lb.start(frequency, 6)
    a, b = np.repeat(np.arange(21), 21), np.tile(np.arange(21), 21)
    lb.train(weights, rng.integers(0, 21, 5000), rng.integers(0, 21, 5000), rng.integers(0, 20, 5000), frequency, rng)
    totals = lb.log_totals(weights, a, b, 50)
    for x, y in [(0, 0), (20, 20), (3, 20), (20, 7)]:
        w = np.arange(20)
        assert np.exp(lb.log_chances(weights, np.full(20, x), np.full(20, y), w, totals)).sum() == pytest.approx(1, abs=1e-5)


def test_words_of_a_class_sum_to_one():
    counts = lm.Counts(12, 4, 1, 2, {0: (5, 1), 1: (7, 3)})
    seen = 10 ** counts.inside(np.array([4, 2, 1, 0]), np.array([1, 1, 1, 1]))
    assert seen.sum() == pytest.approx(1) and counts.inside(np.array([5]), np.array([0]))[0] == 0


def test_training_learns_a_pattern():
    rng = np.random.default_rng(1)
    texts = [np.tile([0, 1, 2, 3], 500) for _ in range(40)]
    a, b, w = lb.contexts(texts, 4)
    frequency = np.full(4, 0.25)
    weights = lb.start(frequency, 8)
    for _ in range(4):
        lb.train(weights, a, b, w, frequency, rng)
    grid = np.repeat(np.arange(5), 5), np.tile(np.arange(5), 5)
    assert lb.log_chances(weights, a, b, w, lb.log_totals(weights, *grid)).mean() > np.log(0.8)


def test_contexts():
    a, b, w = lb.contexts([np.array([1]), np.array([2, 3, 4]), np.array([5, 6])], 9)
    assert list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) == [(9, 9, 1), (9, 9, 2), (9, 2, 3), (2, 3, 4), (9, 9, 5), (9, 5, 6)]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 50)
    rows = [(1, None), (2, ""), (3, "A a\x0bB é"), (4, "w " * 30_000), (None, "a new word"), (3, "A a\x0bB é"), (17, "unseen thing"), (18, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(0)})
    asked = docs.select("*", lm.held_out().alias("held_out"))
    found = lm.scored(asked, head=4, shared=2).collect()
    assert by_id(got(found)) == by_id(plain_base(rows))
    assert lm.scored(asked.limit(0)).count() == 0
    nothing = lm.scored(asked.withColumn("held_out", F.lit(True))).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and {r["base_score"] for r in nothing} == {0.0}
