import random
from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest

from tidewheel.llm import bk_tree, near_dedup, wide_prints
from tidewheel.session import table

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    """{id: text} -> {id: smallest reachable id}, by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in sorted(texts.items())}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("hot", "block"), [(wide_prints.HOT, wide_prints.BLOCK), (8, wide_prints.BLOCK), (wide_prints.HOT, 3)])
def test_stage_keeps_one_of_each_group_of_similarity(spark, sf_dir, monkeypatch, hot, block):
    docs = table(spark, sf_dir, "documents")
    monkeypatch.setattr(near_dedup, "near_texts", lambda d: wide_prints.groups(d, hot, block))
    want = set(plain_groups({r["doc_id"]: r["text"] for r in docs.collect()}).values())
    kept = [r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(want)


def edited(rng, words, part):
    return [f"e{rng.randrange(10**6)}" if rng.random() < part else w for w in words]


def test_recall_of_edited_copies(spark):
    """Groups of copies with random words changed: every pair of similarity 0.8 or more ends in one group, nothing else does."""
    rng = random.Random(7)
    texts, k = {}, 0
    for group in range(60):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([30, 100, 400]))]
        for _ in range(rng.choice([2, 3, 6, 30])):
            texts[k] = " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02])))
            k += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = {r["node"]: r["root"] for r in wide_prints.groups(docs).collect()}
    of = {r["doc_id"]: roots.get(r["n"], r["n"]) for r in docs.select("doc_id", wide_prints.node().alias("n")).collect()}
    want = plain_groups(texts)
    together = [i for i in texts if want[i] != i]
    caught = sum(of[i] == of[want[i]] for i in together)
    assert len(together) > 300 and caught >= 0.99 * len(together)
    of_group = defaultdict(set)
    for i in texts:
        of_group[of[i]].add(want[i])
    assert all(len(w) == 1 for w in of_group.values())


def test_wide_trees_find_what_comparing_all_finds():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (30, 2), np.uint64)
    near = [b ^ np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 14), replace=False)) for _ in range(2)], np.uint64) for b in base for _ in range(5)]
    found = np.concatenate([base, np.array(near), base[:3]])
    trees = np.sort(rng.integers(0, 3, len(found)))
    forest = bk_tree.build(found, trees)
    q, node = bk_tree.search(forest, found, forest.root, 32)
    d = np.bitwise_count(found[:, None] ^ found[None]).sum(2, dtype=int)
    want = np.argwhere((d <= 32) & (trees[:, None] == trees[None]))
    assert sorted(zip(q.tolist(), node.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("wide", [7, wide_prints.WIDE])
def test_alike_is_what_comparing_all_finds(monkeypatch, wide):
    monkeypatch.setattr(wide_prints, "WIDE", wide)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 4), np.uint64)])) for _ in range(60)] + [base[:1], base[:1]]
    left = rng.random(len(sets)) < 0.6
    for right in (left, ~left):
        a, b = wide_prints.alike(sets, left, right)
        own = [set(s.tolist()) for s in sets]
        want = [(i, j) for i in np.flatnonzero(left) for j in np.flatnonzero(right) if i != j and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want))


@pytest.mark.parametrize("block", [wide_prints.BLOCK, 100])
def test_recall_in_a_large_group_where_few_are_alike(spark, block):
    """1,500 copies of one text with four words changed in each: most pairs are near and unlike, and no alike one is lost."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {}
    for k in range(1500):
        words = list(base)
        for at in rng.sample(range(200), 4):
            words[at] = f"x{rng.randrange(10**9)}"
        texts[k] = " ".join(words)
    sets = [wide_prints.shingles(t.encode()) for t in texts.values()]
    every = np.ones(1500, bool)
    a, b = wide_prints.alike(sets, every, every)
    assert len(a) >= 2 * 50
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = {r["node"]: r["root"] for r in wide_prints.groups(docs, block=block).collect()}
    of = {r["doc_id"]: roots.get(r["n"], r["n"]) for r in docs.select("doc_id", wide_prints.node().alias("n")).collect()}
    assert np.mean([of[x] == of[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.99
    assert len(set(of.values())) <= 1500 - len(np.unique(bk_tree.lowest(1500, a, b)[bk_tree.lowest(1500, a, b) != np.arange(1500)])) + 1500 * 0.01


def test_bands_grow_with_the_texts():
    assert wide_prints.bands(10).shape == wide_prints.bands(wide_prints.LEAST).shape == (64, 14)
    assert wide_prints.bands(1 << 28).shape == (173, 20)


def test_texts_on_both_sides_of_the_bound(spark, sf_dir):
    base = [f"w{i}" for i in range(85)]  # 81 shingles
    near = [*base[:40], "x", *base[41:]]  # 76 of 86 shared
    far = [*base[:30], "y", *base[31:55], "z", *base[56:]]  # 71 of 91, below 0.8
    rows = [(1, " ".join(base), None, None, None), (2, " ".join(near), None, None, None), (3, " ".join(far), None, None, None)]
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SHAPE), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_every_pair_of_a_hot_shard_is_searched(spark):
    """Pairs that are near only each other, in one shard that is cut: each is linked, in whatever parts its two are."""
    rng = np.random.default_rng(3)
    chosen = wide_prints.bands(400)
    same = np.unique(chosen[0])
    rows = []
    for k in range(200):
        bits = rng.integers(0, 2, wide_prints.BITS).astype(np.uint8)
        bits[same] = 0  # band 0 is one shard of all
        twin = bits.copy()
        free = np.setdiff1d(np.arange(wide_prints.TREE), same)
        for band in chosen[1:]:  # in no other band together
            if (bits[band] == twin[band]).all() and len(own := np.intersect1d(band, free)):
                twin[own[0]] ^= 1
        rows += [(2 * k, np.packbits(b, bitorder="little").tobytes()) if b is bits else (2 * k + 1, np.packbits(b, bitorder="little").tobytes()) for b in (bits, twin)]
    together = {k for k in range(200) if np.unpackbits(np.frombuffer(rows[2 * k][1], np.uint8)[:16] ^ np.frombuffer(rows[2 * k + 1][1], np.uint8)[:16]).sum() <= wide_prints.RADIUS}
    assert len(together) > 20
    found = wide_prints.components(wide_prints.candidates(spark.createDataFrame(rows, "node long, print binary"), hot=16))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert all(root.get(2 * k) == root.get(2 * k + 1) is not None for k in together)
