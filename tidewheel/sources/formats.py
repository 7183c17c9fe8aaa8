"""Formats and layouts: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _round_trip(df: DataFrame, kind: str, read: dict[str, str] | None = None, write: dict[str, str] | None = None) -> DataFrame:
    """df as the format gives it back, by df's own schema and without inference."""
    path = _place(df.sparkSession, kind)
    df.write.format(kind).options(**(write or {})).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**(read or {})).load(path)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_customers(spark, sf_dir), "parquet", write={"compression": "zstd"})


def orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_customers(spark, sf_dir), "orc")


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_customers(spark, sf_dir), "json", write={"compression": "gzip"})


def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_customers(spark, sf_dir), "csv", {"header": "true"}, {"header": "true"})


def xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_customers(spark, sf_dir), "xml", {"rowTag": "row"}, {"rowTag": "row", "rootTag": "rows"})


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text, counted by their first word."""
    lines = table(spark, sf_dir, "benchmark").select(F.translate("text", "\n\r", "  ").alias("value"))
    path = _place(spark, "text")
    lines.write.text(path)
    return spark.read.text(path).groupBy(F.split_part("value", F.lit(" "), F.lit(1)).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by a column; the filter reads two of its folders."""
    path = _place(spark, "partitioned")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    kept = spark.read.schema(orders.schema).parquet(path).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed by their key, joined without a shuffle of either; their files go with the shared folder."""
    names = []
    for source, key, columns in (("orders", "o_custkey", ["o_custkey", "o_totalprice"]), ("customer", "c_custkey", ["c_custkey", "c_mktsegment"])):
        names.append(f"bucketed_{source}_{uuid.uuid4().hex}")
        table(spark, sf_dir, source).select(columns).repartition(8, key).write.bucketBy(8, key).sortBy(key).option("path", _place(spark, names[-1])).saveAsTable(names[-1])
    orders, customers = (spark.table(n) for n in names)
    joined = orders.join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns in a file, of which a query reads one field."""
    conv = table(spark, sf_dir, "conversations")
    whole = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kept = _round_trip(whole, "parquet")
    return kept.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join("turns.role", ",").alias("roles"))


QUERIES = {f"source_{f.__name__}": f for f in (parquet, orc, json, csv, xml, text, partitioned, bucketed, nested)}
_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"
ORACLE_SQL = {f"source_{k}": _CUSTOMERS for k in ("parquet", "orc", "json", "csv", "xml")} | {
    "source_text": """
        SELECT split_part(translate(text, chr(10) || chr(13), '  '), ' ', 1) AS word, count(*) AS n FROM benchmark GROUP BY 1""",
    "source_partitioned": """
        SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""",
    "source_bucketed": """
        SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "source_nested": """
        SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""",
}
