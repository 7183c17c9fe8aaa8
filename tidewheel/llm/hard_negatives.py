"""Hard negatives by ball trees: rows of other labels that score almost as high as a positive.

Scores are inner products of integer vectors with an anchor. An anchor's positives are its
best rows of the same label; a negative has to score within a window below a positive.

Rows are sorted by length, label and direction over a range partitioning and cut into parts of
bounded size, each of which becomes a ball tree (ball_tree.py) in a written table: a label
with many rows has many trees. Anchors are broadcast a block of bounded bytes at a time, a
stated set of queries against all rows; each task gives its trees' k best for each, which a
window merges. The positives' scores then give the windows of the search for negatives, one for each
anchor and positive score.

Defined results: rows with a null id, label or vector, and those with null or non-finite
components, take no part; vectors of unequal lengths meet in the components that both have;
repeated rows and rows that share an id are rows of their own, and only the anchor's own row
is not its positive; ties go to the smaller id; fewer than asked for give all; an anchor
without positives or negatives has no row; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm import ball_tree
from tidewheel.llm.topk_search import NOBODY, Best, code, stacked, trimmed, whole_numbers
from tidewheel.session import table
from tidewheel.storage import cut

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows of a tree at most, bytes of vectors in it, about, bytes of queries in a broadcast, about, and queries searched together.
PART, PART_BYTES, SENT_BYTES, ASKED = 4096, 1 << 22, 1 << 23, 512
TREE = "width int, ids binary, rows binary, labels binary, weights binary, nodes binary, centre binary, radius binary"
TYPES = {"ids": np.int64, "rows": np.int64, "labels": np.int64, "weights": np.int64, "nodes": np.int64, "centre": np.float64, "radius": np.float64}
#: The window of a search that has none.
ANY = (-np.iinfo(np.int64).max, np.iinfo(np.int64).max)


def valid(vectors: DataFrame, label: Column) -> DataFrame:
    """(id, row, label, terms) of the rows that take part, a written table."""
    terms = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("terms"))
    return cut(terms.where("id is not null and label is not null and terms is not null").withColumn("row", F.monotonically_increasing_id()), "terms")


def planted(terms: DataFrame, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """Ball trees of the rows (id, row, label, terms), a written table."""
    order = ("size", "label", "code", "id", "row")
    placed = terms.withColumns({"code": code(F.col("terms")), "size": F.size("terms")}).repartitionByRange(*order).sortWithinPartitions(*order)

    def grow(own: pd.DataFrame) -> pd.DataFrame:
        ids, rows, labels = (own[c].to_numpy(np.int64) for c in ("id", "row", "label"))
        tree = ball_tree.build(ids, rows, labels, stacked([np.asarray(v, np.int64) for v in own["terms"]]))
        return pd.DataFrame({"width": [tree.weights.shape[1]]} | {c: [np.ascontiguousarray(getattr(tree, c)).tobytes()] for c in TYPES})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= (most := max(1, min(part, part_bytes // (8 * max(1, len(rest["terms"].iloc[-1])))))):
                yield grow(rest[:most])
                rest = rest[most:]
        if rest is not None and len(rest):
            yield grow(rest)

    return cut(placed.select("id", "row", "label", "terms").mapInPandas(build, TREE), "trees")


def _tree(row: dict) -> ball_tree.Tree:
    held = {c: np.frombuffer(row[c], t) for c, t in TYPES.items()}
    n, width = len(held["ids"]), row["width"]
    return ball_tree.Tree(**held | {"weights": held["weights"].reshape(n, width), "nodes": held["nodes"].reshape(-1, 5), "centre": held["centre"].reshape(len(held["radius"]), width)})


def searched(trees: DataFrame, queries: DataFrame, k: int, same: bool, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query, id, score) of the k best rows of each query, a written table.

    queries: (query, row, label, terms, least, most), a written table; query names it.
    """
    spark = trees.sparkSession
    size = queries.agg(F.sum(F.size("terms") * 8 + 48)).first()[0]
    turns = max(1, -(-(size or 0) // sent_bytes))
    found = None
    for turn in range(turns):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn).collect()  # sent_bytes, about
        if not block:
            continue
        numbers = {c: np.array([r[c] for r in block], np.int64) for c in ("query", "row", "label", "least", "most")}
        sent = spark.sparkContext.broadcast((numbers, stacked([np.asarray(r["terms"], np.int64) for r in block])))

        def answer(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            numbers, weights = sent.value
            groups = [slice(begin, begin + ASKED) for begin in range(0, len(weights), ASKED)]
            every = [Best(len(weights[some]), k) for some in groups]
            for batch in batches:
                for row in batch.to_dict("records"):
                    tree = _tree(row)
                    own = trimmed(weights, row["width"])
                    for some, best in zip(groups, every, strict=True):
                        ball_tree.search(tree, ball_tree.Queries(own[some], *(numbers[c][some] for c in ("row", "label", "least", "most"))), best, same)
            for some, best in zip(groups, every, strict=True):
                there = best.id != NOBODY
                yield pd.DataFrame({"query": np.repeat(numbers["query"][some], there.sum(1)), "id": best.id[there], "score": best.score[there]})

        # A task goes through its trees one after the other and keeps one list of the best of all.
        part = cut(trees.repartition("ids").mapInPandas(answer, "query long, id long, score long"), "answers")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query long, id long, score long, rank int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def mined(vectors: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    vectors: vec_id, embedding and what label is made of. anchor: a condition on the id, as column ``id``.
    """
    terms = valid(vectors, label)
    trees = planted(terms)
    anchors = terms.where(anchor)
    asked = anchors.select(F.col("row").alias("query"), "row", "label", "terms", F.lit(ANY[0]).alias("least"), F.lit(ANY[1]).alias("most"))
    kin = searched(trees, cut(asked, "anchors"), positives, True)
    # One search for each anchor and positive score: equal scores have equal windows.
    per_cent = lambda n: F.col("score") * n / 100
    windows = kin.select(F.col("query").alias("row"), "score").distinct().withColumns({"least": F.ceil(per_cent(least)), "most": F.floor(per_cent(most))})
    windows = cut(windows.where("least <= most").withColumn("query", F.monotonically_increasing_id()), "windows")
    windowed = windows.join(anchors.select("row", "label", "terms"), "row").select("query", "row", "label", "terms", "least", "most")
    others = searched(trees, cut(windowed, "windowed"), negatives, False)
    pairs = kin.select(F.col("query").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(windows.select("row", F.col("score").alias("positive_score"), "query"), ["row", "positive_score"])
    pairs = pairs.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    found = pairs.join(others.select("query", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), "query")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of all embeddings, some labels made wrong."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors, F.col("id") % 100 == 0, label)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": """
    WITH e AS (
        SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.n AS a, a.vec_id AS anchor_id, c.vec_id, c.n, a.label = c.label AS kin,
               CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM e a JOIN e c ON a.n <> c.n WHERE a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS r FROM s WHERE kin),
    w AS (
        SELECT p.a, p.n, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.kin AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.r <= 5),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a, n ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM w)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""
}
