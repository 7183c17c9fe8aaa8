"""Exact top-k search by integer inner product, with block-at-a-time pruning.

A vector's dimensions are its terms and its integer components their weights. Vectors
are put in the order of a code of their largest dimensions and cut into blocks of
consecutive ones; a block keeps a forward index (its vectors' weights) and each term's
most and least weight. For a query, the sum over terms of its weight times the most
(or, for a negative weight, the least) is a bound on every score in the block. A query
visits blocks in falling order of bounds, scores whole blocks by their forward index,
and stops when the bound falls below its k-th score so far. That score starts at the
k-th of the query's own block, so most of the pruning needs no exchange.

Blocks are dealt to routes of bounded size, queries go to every route a bounded number
at a time, and a route's best k for each query are merged: a stated set of queries
against all rows in blocks, with k rows a query and route in the last shuffle.

Defined results: rows with a null id, null vectors and those with null or non-finite
components take no part; vectors of unequal lengths meet in the components that both
have, so an empty one scores 0; repeated rows are vectors of their own, except that a
query is asked once (with several vectors, by the least of them) and none is its own
candidate; fewer candidates than k give all; ties go to the smaller id; very long
vectors share blocks with their like; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

K = 5
SCALE = 256
#: Vectors in a block, queries scored together, queries that meet a route at a time, and vectors of a route, about.
BLOCK, ASKED, TURN, ROUTE = 64, 512, 1 << 14, 1 << 14
#: Dimensions in the code that orders vectors.
CODE = 4
#: The score and id of no candidate; the score can be negated.
NONE, NOBODY = -np.iinfo(np.int64).max, np.iinfo(np.int64).max


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as double; null where any is null or not finite."""
    x = vector.cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(ok, F.transform(x, lambda v: F.floor(v * scale)))


def code(terms: Column) -> Column:
    """The dimensions of the largest weights with their signs, largest first."""
    tagged = F.transform(terms, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("term"), (v < 0).alias("sign")))
    return F.transform(F.slice(F.array_sort(tagged), 1, CODE), lambda s: s["term"] * 2 + s["sign"].cast("int"))


def trimmed(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors in the first ``width`` dimensions, with zeros for those they lack."""
    have = min(width, vectors.shape[1])
    return vectors[:, :have] if have == width else np.pad(vectors, ((0, 0), (0, width - have)))


def stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of any lengths as rows as long as the longest."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: in doubles, which are faster, wherever those are exact."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each of some queries; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), NOBODY)

    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score[i, j]: of query q[i] and candidate ids[i, j]."""
        scores = np.column_stack([self.score[q], score])
        names = np.column_stack([self.id[q], ids])
        order = np.lexsort((names, -scores), axis=1)[:, : self.score.shape[1]]
        self.score[q] = np.take_along_axis(scores, order, 1)
        self.id[q] = np.take_along_axis(names, order, 1)


def _against(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of queries against a block; a query's own row comes last of all."""
    score = products(queries, block)
    names = np.broadcast_to(ids, score.shape).copy()
    self_ = own[:, None] == rows
    score[self_], names[self_] = NONE, NOBODY
    return score, names


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[Best, int]:
    """(best, blocks scored): the best of all blocks (ids, rows, weights) for each query.

    own: the queries' rows. floor: for each query, a score that at least k candidates reach somewhere; blocks whose
    bound is lower cannot matter.
    """
    best = Best(len(queries), k)
    most = np.stack([w.max(0) for *_, w in blocks])
    least = np.stack([w.min(0) for *_, w in blocks])
    bound = products(np.maximum(queries, 0), most) + products(np.minimum(queries, 0), least)
    order = np.argsort(-bound, axis=1, kind="stable")
    going, scored = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        at = order[going, turn]
        here = bound[going, at]
        on = here >= np.maximum(best.last()[going], floor[going])
        going, at = going[on], at[on]
        if not len(going):
            break
        for b in np.unique(at):
            q = going[at == b]
            ids, rows, weights = blocks[b]
            best.offer(q, *_against(queries[q], own[q], weights, ids, rows))
            scored += len(q)
    return best, scored


def indexed(terms: DataFrame, query: Column, k: int = K) -> DataFrame:
    """Blocks of vectors (id, row, terms), a written table: ids, rows, weights, and asked, the block's queries.

    A query in asked comes with a floor: its k-th best score in its own block.
    """
    rows = terms.withColumns({"code": code(F.col("terms")), "size": F.size("terms"), "asks": query})
    order = ("size", "code", "id", "row")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "row", "terms", "asks")

    def block(own: pd.DataFrame) -> pd.DataFrame:
        ids, at, weights = own["id"].to_numpy(np.int64), own["row"].to_numpy(np.int64), stacked([np.asarray(v, np.int64) for v in own["terms"]])
        asks = own["asks"].to_numpy(bool)
        best = Best(int(asks.sum()), k)
        if asks.any():
            best.offer(np.arange(len(best.score)), *_against(weights[asks], at[asks], weights, ids, at))
        asked = [{"id": i, "row": r, "weights": w.tobytes(), "floor": f} for i, r, w, f in zip(ids[asks], at[asks], weights[asks], best.last(), strict=True)]
        return pd.DataFrame({"width": [weights.shape[1]], "ids": [ids.tobytes()], "rows": [at.tobytes()], "weights": [weights.tobytes()], "asked": [asked]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= BLOCK:
                yield block(rest[:BLOCK])
                rest = rest[BLOCK:]
        if rest is not None and len(rest):
            yield block(rest)

    return cut(placed.mapInPandas(build, "width int, ids binary, rows binary, weights binary, asked array<struct<id:long,row:long,weights:binary,floor:long>>"), "blocks")


def nearest(vectors: DataFrame, query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    vectors: vec_id and embedding. query: a condition on the id, as column ``id``.
    """
    spark = vectors.sparkSession
    terms = vectors.select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding")).alias("terms"))
    terms = cut(terms.where("id is not null and terms is not null").withColumn("row", F.monotonically_increasing_id()), "terms")
    rows = terms.count()
    blocks = indexed(terms, query, k)
    queries = cut(blocks.select(F.explode("asked").alias("q")).select("q.*"), "queries")
    turns = max(1, -(-queries.count() // TURN))
    routes = max(4 * spark.sparkContext.defaultParallelism, -(-rows // ROUTE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.select(F.pmod(F.xxhash64("ids"), F.lit(routes)).cast("int").alias("route"), every(turns).alias("turn"), "width", "ids", "rows", "weights")
    right = queries.select(every(routes).alias("to_route"), F.pmod(F.xxhash64("row"), F.lit(turns)).cast("int").alias("of_turn"), "id", "row", "weights", "floor")

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        by_width = {}
        for width, i, r, w in zip(own["width"], own["ids"], own["rows"], own["weights"], strict=True):
            i = np.frombuffer(i, np.int64)
            by_width.setdefault(width, []).append((i, np.frombuffer(r, np.int64), np.frombuffer(w, np.int64).reshape(len(i), width)))
        for first in range(0, len(asked) if by_width else 0, ASKED):
            some = asked[first : first + ASKED]
            ids, rows, floor = (some[c].to_numpy(np.int64) for c in ("id", "row", "floor"))
            weights = stacked([np.frombuffer(w, np.int64) for w in some["weights"]])
            for width, parts in by_width.items():
                best, _ = search(trimmed(weights, width), rows, floor, parts, k)
                found = best.id != NOBODY
                out.append(pd.DataFrame({"row": np.repeat(rows, found.sum(1)), "query_id": np.repeat(ids, found.sum(1)), "vec_id": best.id[found], "score": best.score[found]}))
        return pd.concat(out, ignore_index=True)

    merged = left.groupBy("turn", "route").cogroup(right.groupBy("of_turn", "to_route")).applyInPandas(answer, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for each whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op3_topk_blocks": op3_topk_blocks}
ORACLE_SQL = {
    "op3_topk_blocks": """
    WITH e AS (
        SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.n, q.vec_id AS query_id, c.vec_id,
               CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
