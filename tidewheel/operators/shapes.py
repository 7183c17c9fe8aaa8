"""Projection, filters, sets of rows, and changes of shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import table, views


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed columns and a filter; the scan reads three columns."""
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").where(F.col("p_brand").like("Brand#1%") | (F.col("p_size") > 45)).select("p_partkey", size.alias("size"), F.upper("p_brand").alias("brand"))


def sorted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report with an offset: a limit in every task, then in one."""
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(20).select("c_custkey", "c_acctbal")


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as columns."""
    events = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return events.pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).fillna(0)


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as rows."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return part.unpivot("p_partkey", ["size", "price"], "what", "amount")


def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from the first to the last order, and at least 0 (January 1995) to 90, by recursion, with their counts."""
    views(spark, sf_dir, ["orders"])
    # The level covers every month up to the year 9999.
    return spark.sql("""
        WITH RECURSIVE c AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS n, count(*) AS k FROM orders GROUP BY 1),
        m(n, last) MAX RECURSION LEVEL 120000 AS (
            SELECT least(0, min(n)), greatest(90, max(n)) FROM c UNION ALL SELECT n + 1, last FROM m WHERE n < last)
        SELECT m.n AS month, coalesce(k, 0) AS orders FROM m LEFT JOIN c ON m.n = c.n""")


def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in the query, joined to a table."""
    views(spark, sf_dir, ["orders"])
    return spark.sql("""
        SELECT label, count(*) AS n FROM VALUES ('F', 'done'), ('O', 'open'), ('P', 'partial') AS v(status, label)
        JOIN orders ON o_orderstatus = status GROUP BY label""")


def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of query as a pipe of steps."""
    views(spark, sf_dir, ["customer"])
    return spark.sql("""
        FROM customer |> WHERE c_acctbal > 0 |> AGGREGATE count(*) AS n, round(avg(c_acctbal), 4) AS mean GROUP BY c_mktsegment
        |> WHERE n > 10 |> SELECT c_mktsegment AS segment, n, mean""")


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of statements with a variable."""
    views(spark, sf_dir, ["part"])
    return spark.sql("""
        BEGIN
            DECLARE least INT DEFAULT 40;
            SELECT p_brand, count(*) AS n FROM part WHERE p_size >= least GROUP BY p_brand;
        END""")


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of item texts as rows, with their places: how often each occurs, and how far in at first."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("place").cast("long").alias("first"))


def lateral_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of structs as rows: LATERAL VIEW of inline, and of an empty array's one row by OUTER."""
    views(spark, sf_dir, ["nation"])
    return spark.sql("""
        SELECT n_name, v.part, v.size FROM nation
        LATERAL VIEW OUTER inline(filter(array(named_struct('part', 'name', 'size', length(n_name)), named_struct('part', 'key', 'size', n_nationkey)), x -> x.size > 6)) v AS part, size""")


def grouped_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUP BY ALL and ORDER BY ALL: by all columns that are no aggregates."""
    views(spark, sf_dir, ["orders"])
    return spark.sql("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL")


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows, joined: every number from the least customer to the greatest, with the orders of that customer, 0 without any."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    ends = table(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    numbers = spark.range(ends[0] or 0, (ends[1] + 1) if ends[1] is not None else 0)
    return numbers.join(orders, F.col("id") == F.col("o_custkey"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of about a tenth, by a hash of the key and so the same on any cluster."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit("s1/"), F.col("o_orderkey").cast("string"))), 1, 4), 16, 10).cast("int")
    return table(spark, sf_dir, "orders").where(part < 6554).select("o_orderkey", "o_totalprice")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample with a rate for each priority."""
    rate = F.when(F.col("o_orderpriority").startswith("1"), 6554).otherwise(655)
    part = F.conv(F.substring(F.md5(F.concat(F.lit("s2/"), F.col("o_orderkey").cast("string"))), 1, 4), 16, 10).cast("int")
    return table(spark, sf_dir, "orders").where(part < rate).select("o_orderkey", "o_orderpriority")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return c, s


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both, counted."""
    c, s = _keys(spark, sf_dir)
    return c.unionAll(s).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of both once."""
    c, s = _keys(spark, sf_dir)
    return c.union(s).distinct()


def intersected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in both, once."""
    c, s = _keys(spark, sf_dir)
    return c.intersect(s)


def intersected_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in both, as often as in the one that has fewer."""
    c, s = _keys(spark, sf_dir)
    return c.intersectAll(s).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def excepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in no large line, once."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return part.subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey"))


def excepted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first, less as many of the second."""
    c, s = _keys(spark, sf_dir)
    return c.exceptAll(s).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns, matched by name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


QUERIES = {
    f.__name__: f
    for f in (
        projected, sorted_top, pivoted, unpivoted, recursive, inline_values, piped, scripted, exploded, lateral_view, grouped_by_all, ranged, sampled, stratified,
        union_all, union_distinct, intersected, intersected_all, excepted, excepted_all, union_by_name,
    )
}
_C = "SELECT c_nationkey AS k FROM customer"
_S = "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"
ORACLE_SQL = {
    "projected": """
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, upper(p_brand) AS brand
        FROM part WHERE p_brand LIKE 'Brand#1%' OR p_size > 45""",
    "sorted_top": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
    "pivoted": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE event_type = 'click') AS click,
               count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
               count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view
        FROM events GROUP BY 1""",
    "unpivoted": """
        SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
    "recursive": """
        WITH RECURSIVE m(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM m WHERE n < 90),
        c AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS n, count(*) AS k FROM orders GROUP BY 1)
        SELECT m.n AS month, coalesce(k, 0) AS orders FROM m LEFT JOIN c ON m.n = c.n""",
    "inline_values": """
        SELECT label, count(*) AS n FROM (VALUES ('F', 'done'), ('O', 'open'), ('P', 'partial')) v(status, label)
        JOIN orders ON o_orderstatus = status GROUP BY label""",
    "piped": """
        SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer
        WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 10""",
    "scripted": "SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 40 GROUP BY p_brand",
    "exploded": """
        SELECT word, count(*) AS n, CAST(min(place) AS BIGINT) AS first FROM (
            SELECT unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS place FROM benchmark) GROUP BY word""",
    "lateral_view": """
        SELECT n_name, part, size FROM nation LEFT JOIN (
            SELECT n_nationkey AS k, 'name' AS part, CAST(length(n_name) AS INTEGER) AS size FROM nation WHERE length(n_name) > 6
            UNION ALL SELECT n_nationkey, 'key', n_nationkey FROM nation WHERE n_nationkey > 6) ON k = n_nationkey""",
    "grouped_by_all": "SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL",
    "ranged": """
        WITH r AS (SELECT unnest(range(min(c_custkey), max(c_custkey) + 1)) AS id FROM customer)
        SELECT id, count(o_orderkey) AS n FROM r LEFT JOIN orders ON o_custkey = id GROUP BY id""",
    "sampled": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE CAST('0x' || substr(md5('s1/' || CAST(o_orderkey AS VARCHAR)), 1, 4) AS INTEGER) < 6554""",
    "stratified": """
        SELECT o_orderkey, o_orderpriority FROM orders
        WHERE CAST('0x' || substr(md5('s2/' || CAST(o_orderkey AS VARCHAR)), 1, 4) AS INTEGER)
              < CASE WHEN o_orderpriority LIKE '1%' THEN 6554 ELSE 655 END""",
    "union_all": f"SELECT k, count(*) AS n FROM ({_C} UNION ALL {_S}) GROUP BY k",
    "union_distinct": f"{_C} UNION {_S}",
    "intersected": f"{_C} INTERSECT {_S}",
    "intersected_all": f"SELECT k, count(*) AS n FROM ({_C} INTERSECT ALL {_S}) GROUP BY k",
    "excepted": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40",
    "excepted_all": f"SELECT k, count(*) AS n FROM ({_C} EXCEPT ALL {_S}) GROUP BY k",
    "union_by_name": """
        SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
}
