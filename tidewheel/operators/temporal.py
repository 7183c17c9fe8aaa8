"""Time: buckets, windows, gap filling, interpolation, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table


def _plain(c):
    return c.cast("timestamp_ntz")


def _windowed(df: DataFrame, window) -> DataFrame:
    found = df.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(_plain(F.col("w.start")).alias("begin"), _plain(F.col("w.end")).alias("end"), "event_type", "n", "total")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours."""
    return _windowed(table(spark, sf_dir, "events"), F.window("ts", "1 hour"))


def hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours, every hour: an event counts in both."""
    return _windowed(table(spark, sf_dir, "events"), F.window("ts", "2 hours", "1 hour"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events less than six hours apart, merged by Spark's own session window."""
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", _plain(F.col("w.start")).alias("begin"), _plain(F.col("w.end")).alias("end"), "n")


def gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by user and day, with zeros where there were none."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    hourly = events.groupBy("user_id", _plain(F.date_trunc("DAY", "ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = hourly.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = ends.select("user_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return every.join(hourly, ["user_id", "day"], "left").fillna(0, ["n"])


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each user's errors by day, days without one filled on the line between their neighbours."""
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    ends = daily.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = ends.select("user_id", F.explode(F.sequence("a", "b")).alias("day")).join(daily, ["user_id", "day"], "left")
    w = Window.partitionBy("user_id").orderBy("day")  # a row for each day of a user
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("day", "v"))
    sided = every.withColumns({"l": F.last(known, ignorenulls=True).over(back), "r": F.first(known, ignorenulls=True).over(ahead)})
    part = F.try_divide(F.datediff("day", "l.day"), F.datediff("r.day", "l.day"))
    value = F.coalesce(F.col("l.v") + (F.col("r.v") - F.col("l.v")) * part, F.col("l.v"))
    return sided.select("user_id", F.col("day").cast("string").alias("day"), F.round(value, 7).alias("value"))


def time_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a user's values weighted by how long each stood."""
    w = Window.partitionBy("user_id").orderBy("ts")
    stood = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", stood.alias("stood")).where("stood is not null")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("stood")) / F.sum("stood"), 4).alias("mean"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of an hourly count from the hour before, by event type."""
    hourly = table(spark, sf_dir, "events").groupBy("event_type", _plain(F.date_trunc("HOUR", "ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("hour")
    return hourly.select("event_type", "hour", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("change"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users viewed, then clicked within a day, then bought within a day of that."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    day = F.expr("INTERVAL 1 DAY")
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    viewed = F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w)
    clicks = e.withColumn("viewed", viewed).withColumn("ok", (F.col("event_type") == "click") & (F.col("ts") <= F.col("viewed") + day))
    clicked = F.last(F.when(F.col("ok"), F.col("ts")), ignorenulls=True).over(w)
    bought = clicks.withColumn("clicked", clicked).withColumn("won", (F.col("event_type") == "purchase") & (F.col("ts") <= F.col("clicked") + day))
    return bought.agg(
        F.count_distinct(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("viewed"),
        F.count_distinct(F.when(F.col("ok"), F.col("user_id"))).alias("clicked"),
        F.count_distinct(F.when(F.col("won"), F.col("user_id"))).alias("bought"),
    )


QUERIES = {f"time_{f.__name__}": f for f in (tumbling, hopping, session_windows, gap_filled, interpolated, time_weighted, rates, funnel)}
ORACLE_SQL = {
    "time_tumbling": """
        SELECT date_trunc('hour', ts) AS begin, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n,
               round(sum(value), 2) AS total FROM events GROUP BY ALL""",
    "time_hopping": """
        SELECT b AS begin, b + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total
        FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY ALL""",
    "time_session_windows": """
        WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM events
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
        SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "time_gap_filled": """
        WITH h AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events
                   WHERE event_type = 'purchase' GROUP BY 1, 2),
        e AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM h GROUP BY user_id)
        SELECT user_id, CAST(day AS TIMESTAMP) AS day, coalesce(n, 0) AS n FROM e LEFT JOIN h USING (user_id, day)""",
    "time_interpolated": """
        WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1, 2),
        e AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY user_id),
        j AS (SELECT e.user_id, e.day, v, last_value(CASE WHEN v IS NOT NULL THEN e.day END IGNORE NULLS) OVER b AS ld, last_value(v IGNORE NULLS) OVER b AS lv,
                     first_value(CASE WHEN v IS NOT NULL THEN e.day END IGNORE NULLS) OVER a AS rd, first_value(v IGNORE NULLS) OVER a AS rv
              FROM e LEFT JOIN d ON e.user_id = d.user_id AND e.day = d.day
              WINDOW b AS (PARTITION BY e.user_id ORDER BY e.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     a AS (PARTITION BY e.user_id ORDER BY e.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT user_id, CAST(day AS VARCHAR) AS day, round(coalesce(lv + (rv - lv) * ((day - ld) / nullif(CAST(rd - ld AS DOUBLE), 0)), lv), 7) AS value FROM j""",
    "time_time_weighted": """
        WITH s AS (SELECT user_id, value, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS stood FROM events)
        SELECT user_id, round(sum(value * stood) / sum(stood), 4) AS mean FROM s WHERE stood IS NOT NULL GROUP BY user_id""",
    "time_rates": """
        WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, hour, n, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY hour), 0) AS change FROM h""",
    "time_funnel": """
        WITH v AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS viewed FROM events
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        c AS (SELECT *, event_type = 'click' AND ts <= viewed + INTERVAL 1 DAY AS ok FROM v),
        k AS (SELECT *, last_value(CASE WHEN ok THEN ts END IGNORE NULLS) OVER w AS clicked FROM c
              WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewed, count(DISTINCT user_id) FILTER (WHERE ok) AS clicked,
               count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase' AND ts <= clicked + INTERVAL 1 DAY) AS bought FROM k""",
}
