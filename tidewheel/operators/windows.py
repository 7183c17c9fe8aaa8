"""Window functions, and what Spark's frames do not offer rewritten with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table, views


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranking functions over customers of a nation."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    segments = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.row_number().over(w).alias("rn"),
        F.rank().over(segments).alias("rk"),
        F.dense_rank().over(segments).alias("dr"),
        F.round(F.percent_rank().over(w), 6).alias("pr"),
        F.round(F.cume_dist().over(w), 6).alias("cd"),
        F.ntile(4).over(w).alias("quarter"),
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's previous and next, and the days since the previous one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prior = F.lag("o_orderdate").over(w)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("prior"),
        F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("following"),
        F.coalesce(F.datediff("o_orderdate", prior), F.lit(-1)).alias("days"),
    )


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums, and moving means over rows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"),
        F.count(F.lit(1)).over(w.rowsBetween(-1, 1)).alias("around"),
    )


def last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a range of time, not of rows."""
    views(spark, sf_dir, ["events"])
    return spark.sql("""
        SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 4) AS top FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")


def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest purchase value so far at each of a user's events; -1 before the first."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(-1.0)).alias("latest"))


def frame_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and second value of a whole partition."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.first("s_suppkey").over(w).alias("first"),
        F.last("s_suppkey").over(w).alias("last"),
        F.coalesce(F.nth_value("s_suppkey", 2).over(w), F.lit(-1)).alias("second"),
    )


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each priority: the limit is applied before the shuffle too."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w))
    return ranked.where("rn <= 3").select("o_orderpriority", "rn", "o_orderkey", "o_totalprice")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, the latest, as a pre-aggregated maximum and not a sort."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.event_id", "r.value")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions cut where a user pauses for six hours or more: marks of starts, summed."""
    w = Window.partitionBy("user_id").orderBy("ts")
    pause = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    marked = table(spark, sf_dir, "events").withColumn("start", F.when(pause < 6 * 3600, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days with a purchase: equal differences of day and row number."""
    days = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(w)))
    return runs.groupBy("user_id", "run").agg(F.min("day").cast("string").alias("first_day"), F.count(F.lit(1)).alias("days")).drop("run")


def distinct_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many event types a user has shown so far: firsts, summed, in place of a windowed distinct count."""
    seen = Window.partitionBy("user_id", "event_type").orderBy("ts")
    so_far = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = table(spark, sf_dir, "events").withColumn("first", (F.row_number().over(seen) == 1).cast("int"))
    return first.select("event_id", F.sum("first").over(so_far).alias("kinds"))


def sliding_distinct(rows: DataFrame, key: str, at: str, value: str, seconds: int, width: int) -> DataFrame:
    """rows with n_distinct: the different values of the key in the ``seconds`` up to each row's time, the begin left out.

    A value counts from its row until its next occurrence, or until it is ``seconds`` old: one
    up there and one down here, and a row's count is the running sum, by buckets of ``width``
    seconds and what went before them. No row holds a set, and a key is in as many tasks as it
    has buckets. Null keys are a key, null values count for nothing, and times must not be null.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = rows.select(F.col(key).alias("key_"), F.col(value).alias("value_"), micros.alias("t_"), F.struct(*rows.columns).alias("row_"))
    again = F.lead("t_").over(Window.partitionBy("key_", "value_").orderBy("t_"))
    told = timed.where("value_ IS NOT NULL").select("key_", "t_", F.least(again, F.col("t_") + seconds * 1_000_000).alias("end_"))
    steps = told.select("key_", F.explode(F.array(F.struct(F.col("t_"), F.lit(1).alias("step_")), F.struct(F.col("end_").alias("t_"), F.lit(-1).alias("step_")))).alias("s")).select("key_", "s.*", F.lit(None).cast(timed.schema["row_"].dataType).alias("row_"))
    both = steps.unionByName(timed.select("key_", "t_", F.lit(0).alias("step_"), "row_")).withColumn("bucket_", F.floor(F.col("t_") / (width * 1_000_000)))
    before = Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("key_", "bucket_").agg(F.sum("step_").alias("sum_")).select("key_", "bucket_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("key_", "bucket_").orderBy("t_").rangeBetween(Window.unboundedPreceding, 0)
    running = both.withColumn("sum_", F.sum("step_").over(inside)).where("row_ IS NOT NULL").alias("a")
    same = F.col("a.key_").eqNullSafe(F.col("b.key_")) & (F.col("a.bucket_") == F.col("b.bucket_"))
    return running.join(sums.alias("b"), same).select("row_.*", (F.col("sum_") + F.col("before_")).alias("n_distinct"))


def kinds_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many event types a user has shown in the seven days up to each event."""
    return sliding_distinct(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_type", 7 * 86400, 86400).select("event_id", "n_distinct")


def group_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the peer groups from one before to one after, in place of a GROUPS frame."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_brand").orderBy("p_size").rowsBetween(-1, 1)
    return sizes.select("p_brand", "p_size", F.sum("n").over(w).alias("around"))


def without_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the others of a group, in place of EXCLUDE CURRENT ROW."""
    w = Window.partitionBy("s_nationkey")
    others = F.count(F.lit(1)).over(w) - 1
    mean = F.try_divide(F.sum("s_acctbal").over(w) - F.col("s_acctbal"), others)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("mean_of_others"))


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's part of the whole."""
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    whole = per.agg(F.sum("total").alias("whole"))
    return per.join(F.broadcast(whole)).select("o_orderpriority", F.round(F.col("total") / F.col("whole"), 8).alias("share"))  # whole: one row


QUERIES = {
    f.__name__: f
    for f in (
        ranking, neighbours, running_totals, last_week, carried_forward, frame_values, top_per_group, latest_per_key, sessions, islands,
        distinct_so_far, kinds_of_week, group_frames, without_current, share_of_total,
    )
}
ORACLE_SQL = {
    "kinds_of_week": """
        SELECT a.event_id, count(DISTINCT b.event_type) AS n_distinct FROM events a JOIN events b
        ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 7 DAY GROUP BY a.event_id""",
    "ranking": """
        SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER s AS INTEGER) AS rk,
               CAST(dense_rank() OVER s AS INTEGER) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
               CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM customer
        WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), s AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""",
    "neighbours": """
        SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS prior, coalesce(lead(o_orderkey) OVER w, -1) AS following,
               CAST(coalesce(CAST(o_orderdate AS DATE) - CAST(lag(o_orderdate) OVER w AS DATE), -1) AS INTEGER) AS days FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "running_totals": """
        SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
               round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
               count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "last_week": """
        SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 4) AS top FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
    "carried_forward": """
        SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
            (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS latest FROM events""",
    "frame_values": """
        SELECT s_suppkey, first_value(s_suppkey) OVER w AS first, last_value(s_suppkey) OVER w AS last,
               coalesce(nth_value(s_suppkey, 2) OVER w, -1) AS second FROM supplier
        WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "top_per_group": """
        SELECT o_orderpriority, CAST(rn AS INTEGER) AS rn, o_orderkey, o_totalprice FROM (
            SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
    "latest_per_key": """
        SELECT user_id, event_type, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "sessions": """
        WITH m AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) < 21600 THEN 0 ELSE 1 END AS start FROM events
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, CAST(sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM m)
        SELECT user_id, session, count(*) AS n, min(ts) AS begin, max(ts) AS "end" FROM s GROUP BY 1, 2""",
    "islands": """
        WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
        r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d)
        SELECT user_id, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM r GROUP BY user_id, run""",
    "distinct_so_far": """
        WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1 AS INTEGER) AS first FROM events)
        SELECT event_id, CAST(sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS kinds FROM f""",
    "group_frames": """
        SELECT DISTINCT p_brand, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around
        FROM part""",
    "without_current": """
        SELECT s_suppkey, round(coalesce(avg(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0), 4) AS mean_of_others FROM supplier""",
    "share_of_total": """
        SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS share
        FROM orders GROUP BY o_orderpriority""",
}
