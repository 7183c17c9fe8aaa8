"""Near-duplicate documents by SimHash and BK-trees.

Fingerprint: for each of 64 bits, the majority of the XXH64 hashes (seed 42) of a
document's 3-word shingles, repeats included.

Links: equal fingerprints are one node. Two of them within 3 bits agree exactly in
at least one of 4 bit ranges (in general, in blocks - 3 of the blocks), so every
choice of ranges deals the fingerprints to shards by the bits in it, and a shard's
BK-tree finds the rest. Shards are dealt by a shuffle. All shard trees together
grow with the corpus, so they are not broadcast; broadcast are the trees of shards
with more than ``hot`` fingerprints, cut into trees of bounded size and sent a
bounded block at a time to searches that stay where they are. More documents take
more and narrower choices (5 or 6 blocks), so that shards stay small.

near_texts() is the same operator for five words and a similarity of 0.8, which takes wider
fingerprints and an exact comparison (wide_prints.py).

A shard gives each member one link to the lowest of its part, never all pairs;
connected components over those links follow in Spark.

Defined results: a text without words, or null, has fingerprint zero and is linked
like any other; repeated rows are rows of the same component; null doc_ids count
as larger than any other and a component that has nothing else has null; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bk_tree, wide_prints
from tidewheel.llm.components import components
from tidewheel.session import table
from tidewheel.storage import cut

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a shard above which its trees are broadcast in pieces.
HOT = 4096
#: Most nodes of the trees in one broadcast: 280 bytes each.
BLOCK_NODES = 1 << 16
#: Shingles whose bits are counted at once.
PIECE = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one UTF-8 text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    begins, ends = begins[:n].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, n, PIECE):
        spans = zip(begins[i : i + PIECE], ends[i : i + PIECE], strict=True)
        hashes = np.array([digest(joined[b:e], seed) for b, e in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, print): a document's fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(x.as_py(), shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, print long")


def masks(n: int, radius: int = RADIUS, hot: int = HOT) -> list[int]:
    """Bit masks such that any two 64-bit words within the radius agree under one of them.

    64 bits are cut into blocks; a mask takes all but ``radius`` of them. Blocks are
    added until n fingerprints give shards of about hot / 16 at most, on average.
    """
    for blocks in range(radius + 1, radius + 4):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        ranges = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        chosen = [sum(c) for c in combinations(ranges, blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in chosen) <= hot / 16:
            break
    return chosen


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(prints: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the one its label names, without those to itself."""
    other = label != np.arange(len(label))
    return prints[other].view(np.int64), prints[label[other]].view(np.int64)


def shard_links(rows: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """(a, b) links of whole shards, from rows (choice, bits, print) sorted by shard."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        prints = part["print"].to_numpy(np.int64).view(np.uint64)
        tree = part.groupby(["choice", "bits"], sort=False).ngroup().to_numpy()
        forest = bk_tree.build(prints, tree)
        a, b = bk_tree.search(forest, prints, forest.root, radius)
        a, b = _stars(prints, bk_tree.lowest(len(prints), a, b))
        return pd.DataFrame({"a": a, "b": b})

    rest = None
    for part in rows:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        last = part.iloc[-1]
        open_shard = (part["choice"] == last["choice"]) & (part["bits"] == last["bits"])
        rest = part[open_shard]
        whole = part[~open_shard]
        if len(whole):
            yield solve(whole)
    if rest is not None and len(rest):
        yield solve(rest)


def hot_links(members: DataFrame, radius: int = RADIUS, tree_nodes: int = HOT // 2, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(a, b) links within shards by broadcast trees.

    members: (choice, bits, print, n), n the shard's size. A shard is cut by a hash of the
    fingerprint into trees of about tree_nodes nodes, each with the links within it. The
    trees then go out in broadcasts of about block_nodes nodes, each searched by all members
    of the shards it has trees of and by no others; a search gives a link for each part of a
    tree that it meets, not for each node.
    """
    spark = members.sparkSession
    salted = cut(
        members.withColumn("salt", F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / max(tree_nodes, 1))))
        .withColumn("block", F.pmod(F.xxhash64("choice", "bits", "salt"), F.lit(_blocks(members, block_nodes)))),
        "hot",
    )

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        prints = part["print"].to_numpy(np.int64).view(np.uint64)
        forest = bk_tree.build(prints, np.zeros(len(prints), np.int64))
        a, b = bk_tree.search(forest, prints, forest.root, radius)
        label = bk_tree.lowest(len(prints), a, b)
        key = part.iloc[0]
        return pd.DataFrame(
            {"choice": [key["choice"]], "bits": [key["bits"]], "block": [key["block"]], "prints": [prints.tobytes()], "child": [forest.child.tobytes()], "label": [label.tobytes()]}
        )

    trees = cut(
        salted.groupBy("choice", "bits", "salt").applyInPandas(grow, "choice int, bits long, block long, prints binary, child binary, label binary"),
        "trees",
    )
    links = None
    for row in sorted(trees.select("block").distinct().collect()):
        own = trees.where(F.col("block") == row["block"])
        held: dict[tuple[int, int], list[tuple[bytes, bytes, bytes]]] = {}
        for t in own.collect():  # block_nodes nodes, about
            held.setdefault((t["choice"], t["bits"]), []).append((bytes(t["prints"]), bytes(t["child"]), bytes(t["label"])))
        sent = spark.sparkContext.broadcast(held)

        def ask(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for part in parts:
                for shard, own in part.groupby(["choice", "bits"], sort=False):
                    asked = own["print"].to_numpy(np.int64).view(np.uint64)
                    for prints, child, label in sent.value[shard]:
                        prints = np.frombuffer(prints, np.uint64)
                        root = np.zeros(len(prints), np.int64)
                        forest = bk_tree.Forest(prints, root, np.frombuffer(child, np.int32).reshape(-1, bk_tree.BITS + 1))
                        q, node = bk_tree.search(forest, asked, np.zeros(len(asked), np.int64), radius)
                        found = pd.DataFrame({"a": asked[q].view(np.int64), "b": prints[np.frombuffer(label, np.int64)[node]].view(np.int64)})
                        found = found[found["a"] != found["b"]].drop_duplicates()
                        if len(found):
                            yield found

        searching = salted.join(F.broadcast(own.select("choice", "bits").distinct()), ["choice", "bits"], "left_semi")  # no more than the block's trees
        part = cut(searching.select("choice", "bits", "print").mapInPandas(ask, "a long, b long"), "hot-links")
        links = part if links is None else links.union(part)
    return links


def _blocks(members: DataFrame, block_nodes: int) -> int:
    return -(-members.count() // block_nodes)


def print_links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints within the radius of one another.

    prints: a written table of distinct values (print).
    """
    chosen = [_signed(m) for m in masks(prints.count(), radius, hot)]
    dealt = prints.select(
        "print",
        F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)])).alias("s"),
    ).select("s.choice", "s.bits", "print")
    large = cut(dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot-shards")
    some = not large.isEmpty()
    usual = dealt.join(large, ["choice", "bits"], "left_anti") if some else dealt
    links = (
        usual.repartition("choice", "bits")
        .sortWithinPartitions("choice", "bits", "print")
        .mapInPandas(lambda rows: shard_links(rows, radius), "a long, b long")
    )
    return links.union(hot_links(cut(dealt.join(large, ["choice", "bits"]), "members"), radius, max(hot // 2, 1))) if some else links


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot: int = HOT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print, component_id): each row's fingerprint and the smallest doc_id it can reach."""
    rows = cut(fingerprints(docs, shingle), "prints")
    lowest = cut(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(print_links(lowest.select("print"), radius, hot)).withColumnRenamed("node", "print")
    linked = roots.join(lowest, "print")
    heads = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = linked.join(heads, "root").select("print", "component_id")
    ids = cut(
        lowest.join(ids, "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id")), "ids"
    )
    return rows.join(ids, "print").select("doc_id", "print", "component_id")


def near_texts(docs: DataFrame) -> DataFrame:
    """(node, root): distinct texts, by their XXH64, alike in 0.8 of their 5-word shingles; those alone are left out."""
    return wide_prints.groups(docs)


def op1_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_bk": op1_simhash_bk}
ORACLE_SQL: dict[str, str] = {}
