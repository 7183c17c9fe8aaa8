"""Functions written in Python: vectorised by Arrow, and only where Spark has no built-in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from tidewheel.session import table, views


@F.pandas_udf(DoubleType())
def compound(balance: pd.Series, years: pd.Series) -> pd.Series:
    """Balance after some years at 3 %."""
    return (balance * 1.03**years).round(4)


@F.pandas_udf(DoubleType())
def trimmed_sum(values: pd.Series) -> float:
    """Sum without the smallest and the largest tenth."""
    ordered = np.sort(values.to_numpy())
    cut = len(ordered) // 10
    return round(float(ordered[cut : len(ordered) - cut].sum()), 2)


@F.udtf(returnType=StructType().add("step", IntegerType()).add("amount", DoubleType()))
class Instalments:
    """A balance in equal parts, a row for each."""

    def eval(self, balance: float, parts: int) -> Iterator[tuple[int, float]]:
        for step in range(parts):
            yield step, round(balance / parts, 4)


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised scalar function."""
    return table(spark, sf_dir, "customer").select("c_custkey", compound("c_acctbal", F.lit(5)).alias("later"))


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised aggregate of groups of bounded size."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(trimmed_sum("o_totalprice").alias("typical"))


def table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function joined laterally."""
    views(spark, sf_dir, ["supplier"])
    spark.udtf.register("instalments", Instalments)
    return spark.sql("SELECT s_suppkey, step, amount FROM supplier, LATERAL instalments(s_acctbal, 3)")


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function from a group's rows to rows: values as distances from the group's mean in deviations."""

    def scale(own: pd.DataFrame) -> pd.DataFrame:
        v = own["s_acctbal"]
        spread = v.std(ddof=0)
        return pd.DataFrame({"s_suppkey": own["s_suppkey"], "z": ((v - v.mean()) / spread).round(5) if spread else 0.0})

    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(scale, "s_suppkey long, z double")


def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the groups of two tables, both summed by segment or sign before, so that groups are small."""

    def ratio(c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        key = (c["c_nationkey"] if len(c) else s["s_nationkey"]).iloc[0]
        return pd.DataFrame({"nation": [key], "customers": [c["n"].sum()], "suppliers": [s["n"].sum()]})

    n = F.count(F.lit(1)).alias("n")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(n).groupBy("c_nationkey")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_acctbal") > 0).alias("sign")).agg(n).groupBy("s_nationkey")
    return c.cogroup(s).applyInPandas(ratio, "nation int, customers long, suppliers long")


def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function in SQL, which the optimizer sees through."""
    views(spark, sf_dir, ["lineitem"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return spark.sql("SELECT l_linestatus, round(sum(net(l_extendedprice, l_discount)), 2) AS net FROM lineitem GROUP BY l_linestatus")


@F.udf(StringType())
def initials(name: str | None) -> str | None:
    """The first letters of a name's words, a row at a time: only for values too rare to matter."""
    return None if name is None else "".join(word[0] for word in name.split() if word)


@F.arrow_udf(DoubleType())
def discounted(price: pa.Array, part: pa.Array) -> pa.Array:
    """Price less a part, on Arrow arrays without a copy."""
    return pc.round(pc.multiply(price, pc.subtract(1.0, part)), 4)


def row_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one row, over the few names of nations."""
    return table(spark, sf_dir, "nation").select("n_nationkey", initials("n_name").alias("initials"))


def arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function on Arrow arrays."""
    line = table(spark, sf_dir, "lineitem").select("l_linestatus", discounted("l_extendedprice", "l_discount").alias("net"))
    return line.groupBy("l_linestatus").agg(F.round(F.sum("net"), 1).alias("net"))


def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function in SQL, joined laterally, which the optimizer sees through."""
    views(spark, sf_dir, ["nation", "supplier"])
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION suppliers_of(nation INT) RETURNS TABLE (suppliers BIGINT, balance DOUBLE)
        RETURN SELECT count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey = nation""")
    return spark.sql("SELECT n_name, suppliers, coalesce(balance, 0) AS balance FROM nation, LATERAL suppliers_of(n_nationkey)")


QUERIES = {f"udf_{f.__name__.removesuffix('_udf')}": f for f in (scalar_udf, aggregate_udf, table_udf, grouped_map, cogrouped, sql_udf, row_udf, arrow_function, sql_table_function)}
ORACLE_SQL = {
    "udf_scalar": "SELECT c_custkey, round(c_acctbal * pow(1.03::DOUBLE, 5), 4) AS later FROM customer",
    "udf_aggregate": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT o_custkey, round(sum(o_totalprice), 2) AS typical FROM r WHERE rn > n // 10 AND rn <= n - n // 10 GROUP BY o_custkey""",
    "udf_table": "SELECT s_suppkey, CAST(step AS INTEGER) AS step, round(s_acctbal / 3, 4) AS amount FROM supplier, range(3) t(step)",
    "udf_grouped_map": """
        SELECT s_suppkey, round(coalesce((s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_pop(s_acctbal) OVER w, 0), 0), 5) AS z
        FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
    "udf_cogrouped": """
        SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers
        FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1)
        ON c_nationkey = s_nationkey""",
    "udf_row": "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: w[1]), '') AS initials FROM nation",
    "udf_arrow_function": "SELECT l_linestatus, round(sum(round(l_extendedprice * (1 - l_discount), 4)), 1) AS net FROM lineitem GROUP BY 1",
    "udf_sql_table_function": """
        SELECT n_name, count(s_suppkey) AS suppliers, coalesce(round(sum(s_acctbal), 2), 0) AS balance
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    "udf_sql": "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY l_linestatus",
}
