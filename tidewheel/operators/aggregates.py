"""Grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table, views
from tidewheel.storage import cut


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and counts by return flag and line status; one shuffle of partial sums."""
    line = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum(net), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )


def filtered_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One total behind pushed-down range filters on three columns."""
    line = table(spark, sf_dir, "lineitem").where(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("l_discount").between(0.03, 0.07)
        & (F.col("l_quantity") < 24)
    )
    return line.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct counts in one pass over the groups."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_distinct("l_partkey", "l_suppkey").alias("pairs"),
    )


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouping of two columns, told apart by their grouping bits."""
    return (
        table(spark, sf_dir, "orders")
        .cube("o_orderstatus", "o_orderpriority")
        .agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by year and month, by year, and of all."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_totalprice")
    totals = orders.rollup("y", "m").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals.fillna(0, ["y", "m"])


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen groupings only."""
    views(spark, sf_dir, ["customer"])
    return spark.sql("""
        SELECT c_mktsegment, coalesce(c_nationkey, -1) AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS mean
        FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of parts of each group."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.round(F.sum(F.when(kind == "purchase", F.col("value"))), 4).alias("spent"),
        F.bool_or(kind == "error").alias("failed"),
    )


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, correlation and regression within groups."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"),
        F.round(F.var_pop("l_quantity"), 6).alias("var_qty"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"),
        F.round(F.covar_samp("l_quantity", "l_discount"), 8).alias("cov"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
    )


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated quantiles of groups of any size."""
    found = exact_quantiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99, "median": 0.5})
    return found.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p99", "median")))


def exact_quantiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, a column for each of wanted): exact interpolated quantiles; nulls take no part.

    A row's rank in its group is counted by a written range partitioning, the partitions'
    own counts and row numbers within them, so no task and no buffer holds a group.
    """
    held = rows.select(group, value).where(F.col(value).isNotNull())
    dealt = cut(held.repartitionByRange(group, value).sortWithinPartitions(group, value).select(group, value, F.spark_partition_id().alias("part_")), "ranges")
    before = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(group, "part_").agg(F.count(F.lit(1)).alias("n_"))
    parts = parts.select(group, "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("ahead_"), F.sum("n_").over(Window.partitionBy(group)).alias("size_"))
    inside = Window.partitionBy(group, "part_").orderBy(value)
    d, p = dealt.withColumn("rank_", F.row_number().over(inside) - 1).alias("d"), parts.alias("p")
    ranked = d.join(p, F.col(f"d.{group}").eqNullSafe(F.col(f"p.{group}")) & (F.col("d.part_") == F.col("p.part_")))
    rank, aggregates = F.col("rank_") + F.col("ahead_"), []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("size_") - 1)
        # The ranks on both sides of the place, each by how near it is.
        share = F.greatest(F.lit(0.0), 1 - F.abs(rank - at))
        aggregates.append(F.sum(F.when(share > 0, share * F.col(value))).alias(name))
    return ranked.groupBy(F.col(f"d.{group}").alias(group)).agg(*aggregates)


def more_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as texts and sets, the most frequent value, shape of a distribution, any value of a column that has one a group."""
    views(spark, sf_dir, ["customer", "nation"])
    return spark.sql("""
        SELECT n_name, listagg(DISTINCT c_mktsegment, '|') WITHIN GROUP (ORDER BY c_mktsegment) AS segments,
               CAST(size(collect_set(c_mktsegment)) AS BIGINT) AS n_segments, any_value(n_regionkey) AS region,
               mode(c_mktsegment, true) AS most, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 4) AS q1,
               round(percentile_disc(0.75) WITHIN GROUP (ORDER BY c_acctbal), 4) AS q3,
               round(skewness(c_acctbal), 6) AS skew, round(kurtosis(c_acctbal), 6) AS tail
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists and texts of a group's members."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.array_sort(F.collect_list("n_name"))
    return nation.groupBy("r_name").agg(F.array_join(names, ",").alias("names"), F.size(names).cast("long").alias("n"))


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that has a group's largest or smallest value, ties broken by key."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"),
    )


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitwise and boolean aggregates."""
    part = table(spark, sf_dir, "part")
    return part.groupBy("p_brand").agg(
        F.bit_and("p_size").alias("all_bits"),
        F.bit_or("p_size").alias("any_bits"),
        F.bit_xor("p_size").alias("odd_bits"),
        F.bool_and(F.col("p_retailprice") > 0).alias("priced"),
    )


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-width buckets of a value."""
    bucket = F.floor(F.col("o_totalprice") / 10000).cast("int")
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups kept by their aggregates."""
    qty = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return qty.where((F.col("qty") > 150) & (F.col("n") >= 4))


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched distinct counts, held against exact ones: whether each is within 10 %."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    near = line.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("near"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))).alias("sketched"),
    )
    # Beside a distinct count in one aggregation, Spark would keep both sketches for each pair of flag and part.
    exact = line.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    both = exact.join(near.withColumnRenamed("l_returnflag", "flag"), F.col("l_returnflag").eqNullSafe(F.col("flag")))
    close = lambda c: F.abs(F.col(c) - F.col("exact")) <= F.col("exact") * 0.1
    return both.select("l_returnflag", "exact", close("near").alias("near_ok"), close("sketched").alias("sketch_ok"))


def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept by day and merged by event type: the distinct users, within 10 % of exact."""
    events = table(spark, sf_dir, "events")
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("sketch"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("near"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return merged.join(exact, "event_type").select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= F.col("users") * 0.1).alias("ok"))


def two_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly partial aggregates rolled up to days: sums, counts and maxima add up."""
    events = table(spark, sf_dir, "events")
    hourly = events.groupBy("event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")
    )
    return hourly.groupBy("event_type", F.to_date("hour").cast("string").alias("day")).agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.max("top").alias("top")
    )


QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, filtered_revenue, distinct_counts, order_cube, order_rollup, grouping_sets, conditional_counts, moments, quantiles, more_aggregates,
        collected, extremes, bits, histogram, having, approximate_distinct, merged_sketches, two_level_rollup,
    )
}
ORACLE_SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "filtered_revenue": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
          AND l_discount BETWEEN 0.03::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24""",
    "distinct_counts": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
               count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag""",
    "order_cube": """
        SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS gid,
               count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "order_rollup": """
        SELECT CAST(coalesce(y, 0) AS INTEGER) AS y, CAST(coalesce(m, 0) AS INTEGER) AS m, n, total FROM (
            SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total
            FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate)))""",
    "grouping_sets": """
        SELECT c_mktsegment, coalesce(c_nationkey, -1) AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS mean
        FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""",
    "conditional_counts": """
        SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
               count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
               round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent,
               bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id""",
    "moments": """
        SELECT l_linestatus, round(stddev_samp(l_extendedprice), 4) AS sd, round(var_pop(l_quantity), 6) AS var_qty,
               round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_samp(l_quantity, l_discount), 8) AS cov,
               round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_linestatus""",
    "quantiles": """
        SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
               round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(median(o_totalprice), 4) AS median
        FROM orders GROUP BY o_orderpriority""",
    "more_aggregates": """
        WITH c AS (SELECT *, avg(c_acctbal) OVER (PARTITION BY n_name) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey),
        m AS (SELECT n_name, min(c_mktsegment) AS most FROM (SELECT n_name, c_mktsegment, rank() OVER (PARTITION BY n_name ORDER BY count(*) DESC) AS r FROM c GROUP BY 1, 2) WHERE r = 1 GROUP BY 1)
        SELECT n_name, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n_segments,
               any_value(n_regionkey) AS region, any_value(most) AS most, round(quantile_cont(c_acctbal, 0.25), 4) AS q1,
               round(quantile_disc(c_acctbal, 0.75), 4) AS q3,
               round(avg(pow(c_acctbal - mean, 3)) / pow(avg(pow(c_acctbal - mean, 2)), 1.5), 6) AS skew,
               round(avg(pow(c_acctbal - mean, 4)) / pow(avg(pow(c_acctbal - mean, 2)), 2) - 3, 6) AS tail
        FROM c JOIN m USING (n_name) GROUP BY n_name""",
    "collected": """
        SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "extremes": """
        SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest,
               arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_orderpriority""",
    "bits": """
        SELECT p_brand, bit_and(p_size) AS all_bits, bit_or(p_size) AS any_bits, bit_xor(p_size) AS odd_bits,
               bool_and(p_retailprice > 0) AS priced FROM part GROUP BY p_brand""",
    "histogram": """
        SELECT CAST(floor(o_totalprice / 10000) AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1""",
    "having": """
        SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem
        GROUP BY l_orderkey HAVING sum(l_quantity) > 150 AND count(*) >= 4""",
    "approximate_distinct": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near_ok, true AS sketch_ok
        FROM lineitem GROUP BY l_returnflag""",
    "merged_sketches": """
        SELECT event_type, count(DISTINCT user_id) AS users, true AS ok FROM events GROUP BY event_type""",
    "two_level_rollup": """
        SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top
        FROM events GROUP BY 1, 2""",
}
