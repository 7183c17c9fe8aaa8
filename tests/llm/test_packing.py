import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import configurations, packing
from tidewheel.session import table

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, capacity):
    """Pieces rebuild every document, and sequences are gapless, full at most and near the bound."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, own in docs.items():
        ids = np.array([*EXACT.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    used, bound = check(packing.packed(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert used <= bound * 1.02 + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "<|endoftext|> é 漢字", None: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"rank": F.lit("clash"), "n": F.lit(0)})
    check(packing.packed(docs, capacity=64).collect(), texts, 64)
    assert packing.packed(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "a b")] * 50, "doc_id long, text string")
    rows = packing.packed(same, capacity=8).collect()
    assert len(rows) == 50 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 50


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60))
def test_both_libraries_agree(text):
    assert packing.token_ids(text) == EXACT.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.sampled_from([40, 64, 100]))
def test_groups_hold_exactly_the_items(counts, capacity):
    held = defaultdict(int)
    for number, lengths in configurations.pack(counts, capacity, rounds=60):
        assert number > 0 and sum(lengths) <= capacity
        for n in lengths:
            held[n] += number
    assert held == counts


def random_counts(kind, n=20_000, capacity=2048):
    rng = random.Random(2)
    draw = {
        "even": lambda: rng.randrange(1, capacity),
        "short": lambda: 1 + int(rng.expovariate(1 / 300)) % (capacity - 1),
        "thirds": lambda: rng.choice([1100, 700, 690, 683, 400]) * capacity // 2048,
        "long": lambda: rng.randrange(900, 1400) * capacity // 2048,
    }
    return dict(Counter(draw[kind]() for _ in range(n)))


@pytest.mark.parametrize("kind", ["even", "short", "thirds", "long"])
def test_the_program_is_solved(kind):
    """Within 1 % of the best: the solution holds every item, and prices give a bound from below."""
    counts = defaultdict(int)
    for n, k in random_counts(kind).items():
        counts[configurations._class(n, 8)] += k
    solved, bound = configurations.fractional(counts, 256)
    held = defaultdict(float)
    for amount, taken in solved:
        assert amount > 0 and sum(n * k for n, k in taken.items()) <= 256
        for n, k in taken.items():
            held[n] += amount * k
    assert held == pytest.approx(counts)
    assert bound <= sum(a for a, _ in solved) + 1e-6 and sum(a for a, _ in solved) <= 1.01 * bound


def test_configurations_place_the_documents():
    """On real lengths nearly all items are placed by configurations, in no more bins than best-fit takes."""
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    counts = Counter(n for (t,) in texts if (n := (len(packing.token_ids(t or "")) + 1) % 2048))
    for times in (1, 10):
        own = {n: k * times for n, k in counts.items()}
        alone = sum(m for m, _ in configurations.best_fit(configurations._Stock(own), [], 2048))
        made = [configurations.rounded(own, 2048, reserve) for reserve in configurations.RESERVES]
        bins, placed = min(made, key=lambda x: sum(m for m, _ in x[0]))
        assert sum(m for m, _ in bins) <= alone and placed >= 0.95 * sum(own.values())
        assert sum(m for m, _ in configurations.pack(own, 2048)) == sum(m for m, _ in bins)


@pytest.mark.parametrize("kind", ["even", "short", "thirds", "long"])
def test_no_more_bins_than_best_fit(kind):
    counts = random_counts(kind, 2_000, 512)
    alone = sum(m for m, _ in configurations.best_fit(configurations._Stock(counts), [], 512))
    used = sum(m for m, _ in configurations.pack(counts, 512, classes=64))
    assert -(-sum(n * k for n, k in counts.items()) // 512) <= used <= alone


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 12, 4))
        price = rng.random(len(sizes))
        best = 0.0
        stack = [(0, 0.0, 0)]
        while stack:
            k, worth, used = stack.pop()
            best = max(best, worth)
            for j in range(k, len(sizes)):
                if used + sizes[j] <= 20:
                    stack.append((j, worth + price[j], used + sizes[j]))
        taken, worth = configurations.best_configuration(sizes, price, 20)
        assert worth == pytest.approx(best)
        assert sum(n * k for n, k in taken.items()) <= 20
        assert sum(price[list(sizes).index(n)] * k for n, k in taken.items()) == pytest.approx(best)
