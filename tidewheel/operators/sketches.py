"""Approximate aggregates, each held against the exact answer: the queries report whether bounds hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table


def _near(found, exact, part: float):
    return F.abs(found - exact) <= F.abs(exact) * part


def quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate medians by priority: their exact rank is within 2 % of a half."""
    orders = table(spark, sf_dir, "orders")
    near = orders.groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", 0.5, 1000).alias("p50"))
    ranks = orders.join(near, "o_orderpriority").groupBy("o_orderpriority").agg(F.avg((F.col("o_totalprice") <= F.col("p50")).cast("int")).alias("rank"))
    return ranks.select("o_orderpriority", (F.abs(F.col("rank") - 0.5) <= 0.02).alias("ok"))


def kll_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantile sketch of all orders: its 90th percentile is within 3 % in rank."""
    orders = table(spark, sf_dir, "orders")
    sketch = orders.agg(F.kll_sketch_agg_double("o_totalprice", F.lit(400)).alias("s"))
    p90 = sketch.select(F.kll_sketch_get_quantile_double("s", F.lit(0.9)).alias("p90"))
    rank = orders.join(F.broadcast(p90)).agg(F.avg((F.col("o_totalprice") <= F.col("p90")).cast("int")).alias("rank"))  # p90: one row
    return rank.select((F.abs(F.col("rank") - 0.9) <= 0.03).alias("ok"))


def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent event types by a bounded table of counters; with few types they are exact."""
    top = table(spark, sf_dir, "events").agg(F.expr("approx_top_k(event_type, 5, 100)").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("event_type"), F.col("t.count").alias("n"))


def heavy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each language that stand more often than a summary of bounded size can err, with their counts: none is missed, none is off by more.

    Every source makes a summary of 2048 counters, and the sources' summaries are combined by
    language. A count may be off by 3.5 rows of 2048 at most, whatever the number of words.
    """
    counters = 2048
    words = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    parts = words.groupBy("lang", "source").agg(F.expr(f"approx_top_k_accumulate(word, {counters})").alias("part"))
    states = parts.groupBy("lang").agg(F.expr(f"approx_top_k_combine(part, {counters})").alias("state"))
    top = states.select("lang", F.explode(F.expr(f"approx_top_k_estimate(state, {counters})")).alias("t")).select("lang", "t.item", "t.count")
    bound = words.groupBy("lang").agg((F.count(F.lit(1)) * 3.5 / counters).alias("bound"))
    exact = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).join(bound, "lang").where("n > bound")
    met = exact.join(top.withColumnRenamed("item", "word"), ["lang", "word"], "left")
    return met.select("lang", "word", "n", F.coalesce(F.abs(F.col("count") - F.col("n")) <= F.col("bound"), F.lit(False)).alias("ok"))


def count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of users from a count-min sketch kept as a table of cells: never too low, and above by 1 % of all events at most.

    Days' sketches are merged by adding cells; a user's count is the least of its cells'.
    """
    depth, width = 5, 1024
    events = table(spark, sf_dir, "events")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("row"), F.pmod(F.xxhash64("user_id", F.lit(k)), F.lit(width)).alias("cell")) for k in range(depth)])).alias("at")
    daily = events.select(F.to_date("ts").alias("day"), cells).groupBy("day", "at.row", "at.cell").agg(F.count(F.lit(1)).alias("c"))
    sketch = daily.groupBy("row", "cell").agg(F.sum("c").alias("c"))
    exact = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    near = exact.select("user_id", "n", cells).select("user_id", "n", "at.row", "at.cell").join(sketch, ["row", "cell"]).groupBy("user_id", "n").agg(F.min("c").alias("near"))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return near.join(F.broadcast(total)).select("user_id", "n", F.col("near").between(F.col("n"), F.col("n") + F.col("total") / 100).alias("ok"))  # total: one row


def theta_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who both clicked and bought, from an intersection of sketches, within 10 % of exact."""
    events = table(spark, sf_dir, "events")
    sketch = lambda kind: F.theta_sketch_agg(F.when(F.col("event_type") == kind, F.col("user_id")), F.lit(12))
    near = events.agg(F.theta_sketch_estimate(F.theta_intersection(sketch("click"), sketch("purchase"))).alias("near"))
    per = events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    exact = per.agg(F.count_if(F.col("c") & F.col("p")).alias("users"))
    return near.join(F.broadcast(exact)).select("users", _near(F.col("near"), F.col("users"), 0.1).alias("ok"))  # both: one row


def exact_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts by bitmaps of positions, which merge by bucket."""
    users = table(spark, sf_dir, "events").select("event_type", F.bitmap_bucket_number("user_id").alias("bucket"), F.bitmap_bit_position("user_id").alias("bit"))
    maps = users.groupBy("event_type", "bucket").agg(F.bitmap_count(F.bitmap_construct_agg("bit")).alias("n"))
    return maps.groupBy("event_type").agg(F.sum("n").alias("users"))


def numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of few bins that fit the data: the rows up to between two bins are within 5 % of what the bins say."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    bins = orders.agg(F.histogram_numeric("o_totalprice", F.lit(8)).alias("h"))
    ends = bins.select("h", F.transform(F.slice("h", 1, 7), lambda b, k: (b["x"] + F.col("h")[k + 1]["x"]) / 2).alias("ends"))
    placed = orders.join(F.broadcast(ends))  # one row
    counts = placed.groupBy(F.size(F.filter("ends", lambda e: e < F.col("o_totalprice"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"))
    upto = Window.orderBy("bin")  # eight rows
    run = counts.select("bin", F.sum("n").over(upto).alias("exact"), F.aggregate(F.slice("h", F.lit(1), F.col("bin") + 1), F.lit(0.0), lambda s, b: s + b["y"]).alias("near"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.select(F.col("bin").cast("long").alias("bin"), (F.abs(F.col("near") - F.col("exact")) <= 0.05 * F.col("all")).alias("ok"), F.col("all").alias("n"))


QUERIES = {f"sketch_{f.__name__}": f for f in (quantile_sketch, kll_quantiles, heavy_hitters, heavy_words, count_min, theta_overlap, exact_bitmap, numeric_histogram)}
ORACLE_SQL = {
    "sketch_quantile_sketch": "SELECT DISTINCT o_orderpriority, true AS ok FROM orders",
    "sketch_kll_quantiles": "SELECT true AS ok",
    "sketch_heavy_hitters": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "sketch_heavy_words": """
        WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents),
        c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
        b AS (SELECT lang, sum(n) * 3.5 / 2048 AS bound FROM c GROUP BY lang)
        SELECT lang, word, n, true AS ok FROM c JOIN b USING (lang) WHERE n > bound""",
    "sketch_count_min": "SELECT user_id, count(*) AS n, true AS ok FROM events GROUP BY 1",
    "sketch_theta_overlap": """
        SELECT count(*) AS users, true AS ok FROM (SELECT user_id FROM events WHERE event_type = 'click'
        INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')""",
    "sketch_exact_bitmap": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "sketch_numeric_histogram": "SELECT bin, true AS ok, (SELECT count(*) FROM orders) AS n FROM range(8) t(bin)",
}
