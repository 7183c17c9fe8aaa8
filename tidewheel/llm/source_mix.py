"""Mixing sources to target weights by capped water-filling.

Targets start as each source's weighted share of all words. A source whose share
exceeds ``max_epochs`` times its own words is clamped there; the excess goes to the
others in proportion to their weights, until no source is above its clamp. Each
source then repeats every document a whole number of times and takes one more
repetition of the documents that come first in a seeded order, as many as bring
the source to within about half a document of its target.

Only DataFrame functions are used. The text is read once, to count words; all
further work is on (doc_id, source, size, digest) and on tables of sources and of buckets
of the seeded order, so that a source with most of the rows is never in one task.

A row's place in the order is a hash of its doc_id, source, text and, for rows that are
equal in all of these, their number among their equals. Numbers are counted by the parts
of a written table and within them, so that no group of equal rows meets in one task.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; equal rows are taken as often as the target asks, one by one, and it does
not matter which; null and shared doc_ids work like any other; very long texts count
whole; an empty table gives an empty table; other columns are ignored by the query and
kept by mixed_documents().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity() -> Column:
    """A digest of what makes rows equal: doc_id, source and text."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.md5(F.concat_ws("/", told("doc_id"), F.md5(told("source")), F.md5(told("text"))))


def _order_key(seed: str, same: Column, number: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), same, number.cast("string")))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, from 0 among the rows of equal ``same``, to a written table of (row, same, ...).

    row: increasing numbers whose bits from 33 on are the part that a row was written in.
    """
    again = cut(rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equal")
    if again.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long"))
    part = F.shiftrightunsigned("row", 33)
    several = cut(rows.join(again.select("same"), "same", "left_semi").select("row", "same", part.alias("part")), "repeated")
    parts = several.groupBy("same", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("same", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("same", "part").orderBy("row")
    own = several.withColumn("inside", F.row_number().over(inside) - 1).join(ahead, ["same", "part"])
    own = own.select("row", (F.col("ahead") + F.col("inside")).alias("own"))
    return rows.join(own, "row", "left").select(*rows.columns, F.coalesce("own", F.lit(0)).alias("number"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): place counts from 0 in code point order, null last.

    The order comes from a range partitioning and the partitions' own counts, so no
    task holds all sources.
    """
    dealt = cut(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("source", "source_size", F.spark_partition_id().alias("part")),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(F.broadcast(starts), "part").select(  # starts: a row for each shuffle partition
        "source", "source_size", (F.col("start") + F.row_number().over(inside) - 1).alias("place")
    )


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight, ...): shares of all words, clamped and reshared.

    Each round is one sum over the table of sources, and clamps at least one more
    source; the level only rises, so the first round that clamps none is the answer.
    """
    cap = F.col("source_size") * max_epochs
    level = None
    while True:
        free = F.lit(True) if level is None else cap >= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(free, 0).otherwise(cap)).alias("clamped"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.count(F.when(free, 1)).alias("free"),
        ).first()
        if not row["free"] or (level is not None and row["free"] == left):
            break
        left, level = row["free"], (row["total"] - row["clamped"]) / row["weight"]
    share = F.lit(level or 0.0) * F.col("weight")
    return sources.withColumn("target", F.when(cap >= share, share).otherwise(cap.cast("double")))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Plans a mix of ``docs`` (doc_id, text, source); rows: docs is a written table with numbers of its own in ``row``.

    Returns (sized, plan). sized: doc_id, source, size, row, same, order_key for each row. plan, a
    row for each source: source, source_size, target, whole (repetitions of every
    document) and last_key (documents with an order_key up to it are taken once more;
    null: none). repetitions() turns both into numbers of repetitions.
    """
    row = F.col("row") if rows else F.monotonically_increasing_id()
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("row"), identity().alias("same")), "sizes")
    sized = numbered(sized)
    sized = sized.withColumn("order_key", _order_key(seed, F.col("same"), F.col("number"))).drop("number")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = cut(
        ranked_sources(sizes).withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
        ),
        "weights",
    )
    sources = water_fill(sources, max_epochs)
    sources = sources.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    # Buckets of the seeded order: about the square root of the rows, so that neither the
    # buckets of a source nor the rows of a bucket are many.
    digits = max(1, round(math.log(max(sized.count(), 1), 16) / 2))
    bucketed = sized.withColumn("bucket", F.substring("order_key", 1, digits))
    buckets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
    s, b = sources.alias("s"), buckets.alias("b")
    cuts = cut(
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .where((F.col("before") < F.col("need")) & (F.col("upto") >= F.col("need")))
        .select("b.source", "bucket", (F.col("need") - F.col("before")).alias("rest")),
        "cuts",
    )
    c, r = cuts.alias("c"), bucketed.alias("r")
    edge = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bucket") == F.col("c.bucket")))
    tie = edge.groupBy("r.source", "r.order_key", "r.bucket", "rest").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("source", "bucket").orderBy("order_key")
    last = (
        tie.withColumn("upto", F.sum("size").over(inside))
        .groupBy("source", "bucket")
        .agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("order_key"))).alias("in_bucket"))
    )
    # Where not even the bucket's first document fits, all up to the bucket's start are taken.
    last = last.select("source", F.coalesce("in_bucket", "bucket").alias("last_key"))
    s, k = sources.alias("s"), last.alias("k")
    plan = s.join(k, F.col("s.source").eqNullSafe(F.col("k.source")), "left").select(
        "s.source", "source_size", "target", "whole", "last_key"
    )
    return sized, cut(plan, "plan")


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and repetitions to rows that have source and order_key.

    plan is a written table, so Spark knows its size: it is broadcast only below the
    session's threshold, and joined by a shuffle beyond it.
    """
    d, p = rows.alias("d"), plan.alias("p")
    extra = F.when(F.col("d.order_key") <= F.col("p.last_key"), 1).otherwise(0)
    return d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.*", "source_size", "target", (F.col("whole") + extra).alias("repetitions")
    )


def mixed_documents(docs: DataFrame, seed: str = SEED, **params) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, columns unchanged.

    Where no two rows are equal a row's place follows from the row alone; else docs is
    written with row numbers, by which places come back to the rows.
    """
    same = docs.select(identity().alias("same")).groupBy("same").agg(F.count(F.lit(1)).alias("n"))
    kept = F.struct(*docs.columns).alias("doc")
    if same.where("n > 1").isEmpty():
        _, plan = mix(docs, seed=seed, **params)
        placed = docs.select(kept, "source", _order_key(seed, identity(), F.lit(0)).alias("order_key"))
    else:
        held = cut(docs.select(kept, F.monotonically_increasing_id().alias("row")), "numbered")
        sized, plan = mix(held.select("doc.doc_id", "doc.source", "doc.text", "row"), seed=seed, rows=True, **params)
        placed = held.join(sized.select("row", "source", "order_key"), "row")
    once = F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int")))
    return repetitions(placed, plan).where(F.col("repetitions") > 0).select("doc", once.alias("copy")).select("doc.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix of all documents."""
    sized, plan = mix(table(spark, sf_dir, "documents"))
    return repetitions(sized, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken")
    )


QUERIES = {"op9_source_mix": op9_source_mix}
ORACLE_SQL = {
    "op9_source_mix": rf"""
    WITH e AS (
        SELECT doc_id, source,
               CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
               md5(concat_ws('/', coalesce('=' || CAST(doc_id AS VARCHAR), 'null'), md5(coalesce('=' || source, 'null')), md5(coalesce('=' || text, 'null')))) AS same
        FROM documents),
    d AS (SELECT *, md5('{SEED}/' || same || '/' || (row_number() OVER (PARTITION BY same) - 1)) AS k FROM e),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i FROM w),
    p AS (SELECT *, coalesce(sum({MAX_EPOCHS} * source_size) OVER before, 0) AS clamped,
                 coalesce(sum(weight) OVER before, 0) AS gone,
                 sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
          FROM o WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, CAST(total - clamped AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level FROM p),
    l AS (SELECT level FROM f WHERE {MAX_EPOCHS} * source_size >= level * weight ORDER BY i LIMIT 1),
    t AS (SELECT source, source_size,
                 CASE WHEN {MAX_EPOCHS} * source_size >= l.level * weight THEN l.level * weight
                      ELSE CAST({MAX_EPOCHS} * source_size AS DOUBLE) END AS target
          FROM f, l),
    n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    c AS (SELECT d.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
                 sum(size) OVER (PARTITION BY d.source ORDER BY k) AS upto, size AS own
          FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (whole + CASE WHEN need > 0 AND upto - own / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM c"""
}
