import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import bk_tree, near_dedup
from tidewheel.session import table


def plain_print(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc_id: print} -> {doc_id: smallest reachable doc_id}, by comparing all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1 :] ^ values[n]) <= 3):
            a, b = sorted((find(i), find(ids[n + 1 + m])))
            label[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b C", "a b c d", "é É\x0bx  y z\tq" * 3, "same same same same same"])
def test_fingerprint_is_the_plain_one(text):
    assert near_dedup.fingerprint(text.encode() if text is not None else None) == plain_print(text)


def test_trees_find_what_comparing_all_finds():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6))]))
    forest = bk_tree.build(prints, np.zeros(len(prints), np.int64))
    q, node = bk_tree.search(forest, prints, forest.root, 3)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    assert sorted(zip(q.tolist(), node.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**12])
def test_masks_lose_no_pair(n):
    chosen = near_dedup.masks(n)
    rng = np.random.default_rng(n)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in chosen)


@pytest.mark.parametrize("hot", [4096, 8])
def test_components_of_documents(spark, sf_dir, hot):
    docs = table(spark, sf_dir, "documents")
    found = {r["doc_id"]: (r["print"] % 2**64, r["component_id"]) for r in near_dedup.near_duplicates(docs, hot=hot).collect()}
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs.collect()}
    want = plain_components(prints)
    assert found == {i: (prints[i], want[i]) for i in prints}


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y z"), (5, "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("clash")).withColumn("root", F.lit(1))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 2, None: None, 5: 5}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
