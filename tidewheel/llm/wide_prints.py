"""Texts alike in at least 0.8 of their distinct 5-word shingles, by wide SimHashes in BK-trees, checked exactly.

A fingerprint of 64 bits cannot tell a similarity of 0.8 (some 10 bits apart, up to 20) from
none (32, down to 16). So a text's fingerprint has BITS bits here: for each, the majority
of one bit of its distinct shingles' hashes. Bits of texts of similarity s differ with
probability acos(2s / (1 + s)) / pi, 0.152 at 0.8.

Bands: each is a choice of some of the bits, and deals the fingerprints to shards by what
they are there. Two texts of similarity 0.8 share a shard of a band of 14 bits with
probability 0.1, and none of 64 bands with 0.002. A shard's BK-tree, over the first TREE
bits, finds those within RADIUS, three standard deviations more than 0.8 is apart. More
texts take longer bands, so that shards stay small, and more of them, as the number of texts
to the power 0.24, so that recall stays.

A shard gives a star for each of the sets of texts that hang together in it, never their pairs.
Texts that hang together by the stars of all bands are a candidate group, and their exact sets
decide: a group's texts are cut by hash into blocks of at most about BLOCK texts and SHINGLES
shingles, every two blocks (mostly there is one) are compared in a task of their own by
products of their incidence matrices of shared shingles, and of the pairs found alike the task
gives stars again. So no pair of a group goes uncompared, none is written out, and a group of
g texts costs g * g / BLOCK rows of shuffle at most.

Shards of more than HOT texts (groups of very many near copies) are cut by salt into parts of
about HOT / 2, and every two parts meet in a tree of their own, so no pair of a shard goes
unsearched: a shard of g texts is 2 g * g / HOT rows of shuffle.

Texts of equal fingerprints are in one candidate group, and compared like others. A text
without words, or null, has one shingle, the empty one. A text of fewer than five words has
one shingle. Nodes are distinct texts, by XXH64, so repeated rows are one node; very long texts
are a block of their own and are compared whole; an empty table has no groups; columns but
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import bk_tree
from tidewheel.llm.components import components
from tidewheel.storage import cut

SHINGLE = 5
SEED = 42
#: Bits of a fingerprint, and of its part that trees are over.
BITS, TREE = 256, 128
RADIUS = 32
#: Bands and bits of each, up to LEAST texts; beyond, a bit more for every doubling.
BANDS, BAND, LEAST = 64, 14, 1 << 22
#: Probability that a bit of two texts of similarity 0.8 is the same.
SAME = 0.848
#: Texts of a shard above which it is cut.
HOT = 1024
#: Shingles whose bits are counted at once.
PIECE = 1 << 13
#: Texts and shingles of a block of a candidate group, and shingles that stand in a matrix at once.
BLOCK, SHINGLES, WIDE = 1024, 1 << 19, 1 << 11
#: Rows of a batch that are worked on at once.
SLICE = 256
#: Bits of the filter before the texts to compare are shuffled; more texts pass more rows and lose none.
SLOTS = 1 << 23


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[b:e], SEED) for b, e in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of 64 bits of the fingerprint of a text's shingles."""
    ones = np.zeros(BITS, np.int64)
    steps = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), PIECE):
        wide = _mixed(hashes[k : k + PIECE, None] + steps)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def bands(n: int) -> np.ndarray:
    """[band, bit]: the bits of each band, for n texts."""
    more = max(0, ceil(log2(max(n, 1) / LEAST)))
    rng = np.random.default_rng(SEED)
    number = ceil(BANDS * SAME**-more)
    return np.stack([rng.choice(BITS, BAND + more, replace=False) for _ in range(number)])


def node(text: str = "text") -> Column:
    return F.xxhash64(text)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text), each node once a task, few at a time: a worker keeps the memory it once took."""
    seen: set[int] = set()
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            first = []
            for i, n in enumerate(part.column(0).to_pylist()):
                if n not in seen:
                    seen.add(n)
                    first.append(i)
            if first:
                yield part.take(pa.array(first, pa.int64()))


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each of SLOTS hash values that the nodes have; of one size whatever their number."""
    slot = F.pmod("node", F.lit(SLOTS)) + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = np.zeros(SLOTS // 8, np.uint8)
    for row in parts.collect():  # SLOTS / 32768 rows at most
        part = np.frombuffer(row["bits"], np.uint8)
        begin = (row["k"] - 1) * 4096
        found[begin : begin + len(part)] = part
    return found


def prints(docs: DataFrame) -> DataFrame:
    """(node, print, shingles) of all distinct texts; print is the fingerprint's words, joined, shingles their number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):
            sets = [shingles(text.as_py()) for text in batch.column(1).cast(pa.binary())]
            found = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), found, pa.array([len(s) for s in sets], pa.int64())], ["node", "print", "shingles"])

    return docs.select(node().alias("node"), "text").mapInArrow(each, "node long, print binary, shingles long").dropDuplicates(["node"])


def shard_links(rows: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """(a, b): stars of the nodes that hang together in whole shards, from rows (shard, salt, node, p0, p1) sorted by shard and salt."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        trees = part.groupby(["shard", "salt"], sort=False).ngroup().to_numpy()
        sizes = np.bincount(trees)
        part, trees = part[sizes[trees] > 1], trees[sizes[trees] > 1]
        found = np.ascontiguousarray(part[["p0", "p1"]].to_numpy(np.int64)).view(np.uint64)
        names = part["node"].to_numpy(np.int64)
        forest = bk_tree.build(found, np.unique(trees, return_inverse=True)[1] if len(trees) else trees)
        q, at = bk_tree.search(forest, found, forest.root, radius)
        head = bk_tree.lowest(len(found), q[q < at], at[q < at])
        other = names != names[head]
        return pd.DataFrame({"a": names[head[other]], "b": names[other]})

    rest = None
    for part in rows:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        last = part.iloc[-1]
        open_shard = (part["shard"] == last["shard"]) & (part["salt"] == last["salt"])
        rest, whole = part[open_shard], part[~open_shard]
        if len(whole):
            yield solve(whole)
    if rest is not None and len(rest):
        yield solve(rest)


def _dealt(distinct: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(shard, node, p0, p1): every fingerprint once a band; a shard is a band and what the fingerprint is there."""
    weights = 1 << np.arange(chosen.shape[1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            shards = np.stack([bits[:, own] @ weights + (k << chosen.shape[1]) for k, own in enumerate(chosen)], 1)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(chosen), pa.int32()), pa.array(shards.reshape(-1)))
            first = [pa.array(words[:, k].view(np.int64)) for k in range(2)]
            yield pa.record_batch([batch.column(0), *first, keys], ["node", "p0", "p1", "shards"])

    found = distinct.select("node", "print").mapInArrow(each, "node long, p0 long, p1 long, shards array<long>")
    return found.select(F.explode("shards").alias("shard"), "node", "p0", "p1")


def candidates(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links that make the candidate groups, from the written table of (node, print) with distinct fingerprints."""
    dealt = _dealt(distinct, bands(distinct.count()))
    large = cut(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot-shards")
    names = ["shard", "salt", "node", "p0", "p1"]
    rows = dealt.withColumn("salt", F.lit(0).cast("long"))
    if not large.isEmpty():
        salts = F.ceil(F.col("n") / (hot // 2))
        part = F.pmod(F.xxhash64("node", "shard"), F.col("salts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
        salted = dealt.join(large.select("shard", salts.alias("salts")), "shard").withColumn("part", part).withColumn("other", other)
        meeting = F.least("part", "other") * F.col("salts") + F.greatest("part", "other")
        rows = rows.join(large, "shard", "left_anti").select(*names).union(salted.withColumn("salt", meeting).select(*names))
    dealt_out = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "node")
    # All heads of a text hang together by it: each but the least is linked to that one, so equal links fall together.
    heads = dealt_out.mapInPandas(shard_links, "a long, b long").groupBy("b").agg(F.collect_set("a").alias("heads"))  # one a band at most, or a meeting of two parts of one
    least = F.array_min("heads")
    ways = F.transform(F.filter("heads", lambda h: h != least), lambda h: F.struct(least.alias("a"), h.alias("b")))
    return heads.select(F.explode(F.concat(F.array(F.struct(least.alias("a"), F.col("b").alias("b"))), ways)).alias("w")).select("w.a", "w.b").distinct()


def links(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b): nodes that nodes of exact similarity 0.8 or more join."""
    every = cut(prints(docs), "prints")
    first = cut(every.groupBy("print").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "distinct")
    equal = every.join(first.where("n > 1").select("print", F.col("node").alias("a")), "print").where("a <> node").select("a", F.col("node").alias("b"))
    roots = cut(components(candidates(first, hot).union(equal)), "candidates")
    return compared(docs, roots.join(every.select("node", "shingles"), "node"), block)


def compared(docs: DataFrame, grouped: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): stars of the nodes alike in each group; grouped: (node, root, shingles)."""
    sizes = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("shingles") / SHINGLES)).alias("blocks"))
    placed = cut(grouped.select("node", "root").join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node", "root"), F.col("blocks"))), "placed")
    # A text goes to its block's meeting with every block of the group, itself included.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    texts = _texts(docs, placed).join(placed, "node").select("node", "text", "root", "block", other)
    meetings = texts.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    return meetings.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(_meetings, "a long, b long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the nodes alike, from rows (root, i, j, block, node, text) sorted by meeting."""
    meeting, nodes, sides, sets = None, [], [], []

    def solve() -> pa.RecordBatch:
        a, b = alike(sets, np.array(sides) == meeting[1], np.array(sides) == meeting[2])
        head = bk_tree.lowest(len(nodes), a, b)
        names = np.array(nodes)
        other = head != np.arange(len(nodes))
        return pa.record_batch([pa.array(names[head[other]]), pa.array(names[other])], ["a", "b"])

    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            keys = zip(*(part.column(k).to_pylist() for k in range(5)), part.column(5).cast(pa.binary()), strict=True)
            for root, i, j, block, name, text in keys:
                if meeting != (root, i, j):
                    if len(nodes) > 1:
                        yield solve()
                    meeting, nodes, sides, sets = (root, i, j), [], [], []
                nodes.append(name)
                sides.append(block)
                sets.append(shingles(text.as_py()))
    if len(nodes) > 1:
        yield solve()


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a left and a right set whose exact similarity is 0.8 or more."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times[column] > 1
    order = np.argsort(column[shared], kind="stable")
    row, column = row[shared][order], np.unique(column[shared], return_inverse=True)[1][order]
    both = np.zeros((int(left.sum()), int(right.sum())), np.float32)  # whole numbers below 2 ** 24, for texts of fewer words
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + WIDE, WIDE))
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            part = np.zeros((len(sets), WIDE), np.float32)
            part[row[begin:end], column[begin:end] - column[begin] // WIDE * WIDE] = 1
            both += part[left] @ part[right].T
    # In whole numbers, similarity 0.8 is 4 of 5.
    a, b = np.nonzero(5 * both >= 4 * (size[left][:, None] + size[right][None] - both))
    a, b = np.flatnonzero(left)[a], np.flatnonzero(right)[b]
    return a[a != b], b[a != b]


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the nodes asked for, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(asked))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column(0).to_numpy() % SLOTS
                bits = sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                for begin in range(0, batch.num_rows, SLICE):
                    yield batch.slice(begin, SLICE).filter(pa.array(bits[begin : begin + SLICE].astype(bool)))

        return _once(passing())

    texts = docs.select(node().alias("node"), "text").mapInArrow(wanted, "node long, text string")
    return texts.join(asked.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])


def groups(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(node, root) of the texts that have others like them; all other texts stand alone."""
    return components(links(docs, hot, block))
