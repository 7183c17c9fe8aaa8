"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.storage import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round takes every node to the smallest of itself and its neighbours, from there on
    to where that ends, and the links along with their nodes: links within one end go, equal
    ones fall together. So a round joins only the links that the rounds before left, not all
    links again. A node that keeps links has taken in another within two rounds, so the nodes
    at least halve. Labels are made by pre-aggregated minima; a node with very many links
    skews only joins that Spark can split. Each round is a written table, so a lost executor
    costs no earlier round. Self links and repeated links are harmless; no links give an
    empty table.
    """
    left = cut(_ordered(links), "links")  # links is run once
    rounds = []
    while True:
        ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("low")), F.struct(F.col("b").alias("node"), F.col("a").alias("low"))))
        lowest = left.select(ways.alias("w")).groupBy("w.node").agg(F.min("w.low").alias("root"))
        rounds.append(_ended(cut(lowest, "labels")))
        first, second = (rounds[-1].select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        moved = left.join(first, "a").join(second, "b").where("a_root <> b_root")
        after = cut(_ordered(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "links")
        drop(left)
        left = after
        if left.isEmpty():
            drop(left)
            break
    # What the last round made of its few nodes is told to the round before, and so back to the first.
    found = rounds.pop()
    while rounds:
        own = rounds.pop()
        later = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        told = cut(own.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels")
        drop(own)
        drop(found)
        found = told
    return found


def _ordered(links: DataFrame) -> DataFrame:
    """The distinct links, each with its smaller node first."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ended(labels: DataFrame) -> DataFrame:
    """Written labels (node, root), each followed to a node that is its own label; a label is itself a node."""
    while True:
        ends = labels.select(F.col("node").alias("root"), F.col("root").alias("end"))
        after = cut(labels.join(ends, "root").select("node", F.col("end").alias("root"), F.col("root").alias("was")), "labels")
        drop(labels)
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels
