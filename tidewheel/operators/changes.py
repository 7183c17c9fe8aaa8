"""Tables that change: keyed merges with history, and reachability by rounds of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut


def merged(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current (unique by key) after changes: each key's last change counts, by one full outer join.

    changes: current's columns, op (upsert or delete), and at and seq, which order them. A
    change of a null key has no effect; a delete of an unknown key neither.
    """
    columns = current.columns
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("op", *columns), F.struct("at", "seq")).alias("change_"))
    met = current.select(key, F.struct(*columns).alias("row_")).join(last, key, "full")
    kept = met.where(F.col("change_").isNull() | (F.col("change_.op") != "delete"))
    return kept.select(*[F.when(F.col("change_").isNull(), F.col(f"row_.{c}")).otherwise(F.col(f"change_.{c}")).alias(c) for c in columns])


def historied(history: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """history with the validity ranges that changes open and close: its columns are the row's, valid_from and valid_to (null: still valid).

    A key's rows are valid from one change to the next, and none is from a delete on. Ranges
    closed before stay as they are; the open ones of changed keys take part as changes of their
    begin. Successors are found inside the parts of a range partitioning, and of each part's
    last rows in the next part of the key, so a key with very many changes is in many tasks.
    Changes of one key and time are valid in the order of seq, all but the last for no time,
    and left out.
    """
    columns = [c for c in history.columns if c not in ("valid_from", "valid_to")]
    closed = history.where("valid_to IS NOT NULL")
    open_ = history.where("valid_to IS NULL")
    changes = changes.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    touched = changes.select(key).distinct()
    same = open_.join(touched, key, "left_anti").select(history.columns)
    begun = open_.join(touched, key, "left_semi").select(*columns, F.lit("upsert").alias("op"), F.col("valid_from").alias("at"), F.lit(None).cast(changes.schema["seq"].dataType).alias("seq"))
    rows = begun.unionByName(changes.select(*columns, "op", "at", "seq"))
    by = (key, "at", F.col("seq").asc_nulls_first())
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place_", F.monotonically_increasing_id()), "changes")
    part = F.shiftright("place_", 33)
    inside = placed.withColumn("part_", part).withColumn("next_", F.lead("at").over(Window.partitionBy(key, "part_").orderBy("place_")))
    firsts = placed.groupBy(key, part.alias("part_")).agg(F.min_by("at", "place_").alias("first_"))
    ahead = firsts.select(key, "part_", F.lead("first_").over(Window.partitionBy(key).orderBy("part_")).alias("ahead_"))  # a row for each part of a key
    ranged = inside.join(ahead, [key, "part_"]).withColumn("valid_to", F.coalesce("next_", "ahead_"))
    valid = ranged.where("op <> 'delete' AND (valid_to IS NULL OR valid_to > at)")
    return closed.unionByName(same).unionByName(valid.select(*columns, F.col("at").alias("valid_from"), "valid_to"))


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops) of all nodes that seeds (node) reach over edges (a, b), with the fewest steps.

    Each round joins only the nodes that the last one found (semi-naive evaluation), and what
    it finds new is a written table, so a lost executor costs no earlier round. A node with very
    many edges skews only a join that Spark can split. No round broadcasts: edges and nodes would
    pass the driver once a round, and small files are large tables. Null nodes reach nothing.
    """
    edges = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    delta = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "reached")
    every = delta
    while not delta.isEmpty():
        near = delta.join(edges.hint("merge"), F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.col("hops") + 1).toDF("node", "hops").distinct()
        delta = cut(near.join(every.select("node").hint("merge"), "node", "left_anti"), "reached")
        every = every.unionByName(delta)
    return every


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of before 2001 with their history after two batches of changes: later orders come, open ones are closed, small ones of low priority go, and all urgent ones come back dearer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    columns = orders.columns[:3]
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    late, urgent = F.col("o_orderdate") >= day("2001-01-01"), F.col("o_orderpriority") == "1-URGENT"
    change = lambda rows, op, at, seq: rows.select(*columns, F.lit(op).alias("op"), at.alias("at"), F.lit(seq).alias("seq"))
    history = orders.where(~late).select(*columns, F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    closing = orders.where("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("F"))
    first = change(orders.where(late), "upsert", F.col("o_orderdate"), 1).unionByName(change(closing, "upsert", day("2002-01-01"), 2))
    small = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 100000)
    dearer = orders.where(urgent).withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("R")})
    second = change(orders.where(small), "delete", day("2002-02-01"), 1).unionByName(change(dearer, "upsert", day("2002-03-01"), 2)).unionByName(change(orders.where(urgent), "delete", day("2002-02-01"), 3))
    for batch in (first, second):
        history = cut(historied(history, batch, "o_orderkey"), "history")
    return history


def orders_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a batch of inserts, updates and deletes, as they are then."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    current = orders.where("o_orderstatus <> 'P'")
    change = lambda where, op, seq: orders.where(where).select("*", F.lit(op).alias("op"), F.lit(1).alias("at"), F.lit(seq).alias("seq"))
    changes = change("o_orderstatus = 'P'", "upsert", 1).unionByName(change("o_totalprice < 50000", "delete", 2)).unionByName(change("o_totalprice < 20000", "upsert", 3).withColumn("o_orderstatus", F.lit("N")))
    return merged(current, changes, "o_orderkey")


def customers_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps customers are from the first one, a step being a part that both returned in quantity."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 44")
    bought = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"))
    edges = bought.toDF("a", "b").union(bought.select("p", "c"))
    found = reached(edges, bought.agg(F.min("c").alias("node")))
    return found.where("node LIKE 'c%'").select(F.substring("node", 2, 20).cast("long").alias("customer"), (F.col("hops") / 2).cast("int").alias("steps"))


QUERIES = {f.__name__: f for f in (order_history, orders_merged, customers_reached)}
ORACLE_SQL = {
    "order_history": """
        WITH c AS (
            SELECT o_orderkey, o_orderstatus, o_totalprice, 'upsert' AS op, o_orderdate AS since, 1 AS seq FROM orders
            UNION ALL SELECT o_orderkey, 'F', o_totalprice, 'upsert', TIMESTAMP '2002-01-01', 2 FROM orders WHERE o_orderstatus = 'O'
            UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'delete', TIMESTAMP '2002-02-01', 3 FROM orders
            WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW' AND o_totalprice < 100000
            UNION ALL SELECT o_orderkey, 'R', o_totalprice * 2, 'upsert', TIMESTAMP '2002-03-01', 4 FROM orders WHERE o_orderpriority = '1-URGENT'),
        r AS (SELECT *, lead(since) OVER (PARTITION BY o_orderkey ORDER BY since, seq) AS valid_to FROM c)
        SELECT o_orderkey, o_orderstatus, o_totalprice, since AS valid_from, valid_to FROM r WHERE op <> 'delete'""",
    "orders_merged": """
        SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
        WHERE o_totalprice < 20000 OR o_totalprice >= 50000""",
    "customers_reached": """
        WITH RECURSIVE b AS (
            SELECT DISTINCT 'c' || o_custkey AS c, 'p' || l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 44),
        e AS (SELECT c AS a, p AS b FROM b UNION ALL SELECT p, c FROM b),
        r(node, hops) AS (SELECT min(c), 0 FROM b UNION SELECT e.b, hops + 1 FROM r JOIN e ON node = e.a WHERE hops < 120)
        SELECT CAST(node[2:] AS BIGINT) AS customer, CAST(min(hops) // 2 AS INTEGER) AS steps FROM r WHERE node LIKE 'c%' GROUP BY node""",
}
