"""Streams of events: files as they arrive, watermarks, windows and state, to files.

Each query runs its stream over what is there and ends, with its checkpoint and its
result in the shared folder. Results are of closed windows where the sink appends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewheel.session import table
from tidewheel.sources import committed
from tidewheel.storage import shared_folder


#: Milliseconds of event time after which a user's state times out.
QUIET = 2 * 86_400_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with event time that watermarks accept; the pattern lets one file or a folder be the input."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_files(stream: DataFrame) -> DataFrame:
    """The rows that an appending stream has written when it has read all there is."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def run_by_batch(stream: DataFrame, keys: list[str], mode: str = "update", place: str | None = None, once: bool = False) -> DataFrame:
    """The latest row of each key that an updating stream has given, by foreachBatch.

    Every batch is a folder named by its number, so a batch that runs again replaces itself.
    A run goes on where the last one of the same place stopped. once: by a single batch, for
    state that expires by the clock, for whose sake a stream would never be done.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    trigger = {"once": True} if once else {"availableNow": True}

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/part={number}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(**trigger).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch_", IntegerType())])).parquet(f"{place}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_").alias("v")).select(*keys, "v.*")


def _plain(c):
    return c.cast("timestamp_ntz")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour, of the hours that the watermark has passed."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    out = run_to_files(w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")))
    return out.select(_plain(F.col("w.start")).alias("begin"), "event_type", "n", "top")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that have ended."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id")
    return run_to_files(w.agg(F.count(F.lit(1)).alias("n"))).select("user_id", _plain(F.col("w.start")).alias("begin"), "n")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and type within the watermark, which here spans all."""
    kept = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_files(kept.select("user_id", "event_type", "ts")).select("user_id", "event_type")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined to a table."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = event_stream(spark, sf_dir).where("event_type = 'purchase'").join(customers, "user_id")
    return run_to_files(joined.select("event_id", "user_id", "c_mktsegment", "value"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined: clicks and the purchases of the same user within an hour after."""
    clicks = event_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked")).withWatermark("clicked", "2 hours")
    bought = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "ts").withWatermark("ts", "2 hours")
    soon = F.expr("user_id = u AND ts >= clicked AND ts <= clicked + INTERVAL 1 HOUR")
    return run_to_files(clicks.join(bought, soon)).select("click_id", "event_id")


def stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count and a maximum for each user in state of our own."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, top = n + len(batch), max(top, float(batch["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    shape = "n long, top double"
    found = event_stream(spark, sf_dir).groupBy("user_id").applyInPandasWithState(update, f"user_id long, {shape}", shape, "update", GroupStateTimeout.NoTimeout)
    return run_by_batch(found, ["user_id"])


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by type without a window, as updates."""
    totals = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return run_by_batch(totals, ["event_type"])


def late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours counted from two folders, the second with events from long before: those are too late, and dropped.

    The first folder is read by a run of its own, so the watermark has passed the old hours when the second comes.
    """
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/late-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts").alias("last")).first()["last"]
    old = (events.where("event_type = 'view'").withColumn("ts", F.expr("ts - INTERVAL 1 DAY"))).where(F.col("ts") < F.lit(last) - F.expr("INTERVAL 2 DAYS"))
    events.write.parquet(f"{place}/in/run=1")
    stream = spark.readStream.schema(events.schema).parquet(f"{place}/in/*")
    counts = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    for turn in range(2):  # the second run starts from the first one's checkpoint
        query = counts.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if not turn:
            old.write.parquet(f"{place}/in/run=2")
    return spark.read.schema(counts.schema).parquet(f"{place}/rows").select(_plain(F.col("w.start")).alias("begin"), "event_type", "n")


def hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two hours, every hour, of the windows that the watermark has passed."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"))
    out = run_to_files(w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought")))
    return out.select(_plain(F.col("w.start")).alias("begin"), "n", "bought")


def timed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who have been quiet for two days of event time, by a timeout of their state: their last event, and the number up to it.

    Two runs: the first reads the events, and the second, of one later event, moves the watermark on.
    """
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/quiet-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{place}/in/run=1")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="ms", tz="UTC")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n, last = n + len(batch), max(last, batch["ts"].max().value // 10**6)
        state.update((n, last))
        state.setTimeoutTimestamp(last + QUIET)

    stream = spark.readStream.schema(events.schema).parquet(f"{place}/in/*").withWatermark("ts", "1 minute")
    found = stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    for turn in range(2):
        query = found.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if not turn:
            late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.expr("ts + INTERVAL 1 HOUR").alias("ts"))
            late.write.parquet(f"{place}/in/run=2")
    rows = spark.read.schema(found.schema).parquet(f"{place}/rows")
    return rows.select("user_id", "n", _plain(F.col("last")).alias("last"))


class UserTotals(StatefulProcessor):
    """A count of each user's events by the newer interface to state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(map(len, rows))
        self.n.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


class Reminders(StatefulProcessor):
    """For each user, a reminder a day of event time after each purchase; it is due with the purchases so far.

    What is due is one list in the user's state, in order, and a timer stands for its first only:
    a timer for each purchase is a call to the state store and a frame of one row for each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "n long, due array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        n, due = self.state.get() or (0, [])
        first, due = due[0] if due else None, set(due)
        for batch in rows:
            n += len(batch)
            due.update(at.value // 10**6 + 86_400_000 for at in batch["ts"])
        if due and (first is None or min(due) < first):
            self.handle.registerTimer(min(due))
        self.state.update((n, sorted(due)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        n, due = self.state.get()
        passed = timerValues.getCurrentWatermarkInMs()
        now = [at for at in due if at <= passed]
        later = due[len(now) :]
        if now:  # a timer of what an earlier one has found due finds nothing
            self.state.update((n, later))
            if later:
                self.handle.registerTimer(later[0])
            yield pd.DataFrame({"user_id": key[0], "due": now, "n": n})

    def close(self) -> None:
        pass


@contextmanager
def _rocks_db(spark: SparkSession) -> Iterator[None]:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of each user's events by a stateful processor, whose state is kept by RocksDB."""
    with _rocks_db(spark):
        found = event_stream(spark, sf_dir).groupBy("user_id").transformWithStateInPandas(UserTotals(), "user_id long, n long", "Update", "None")
        return run_by_batch(found, ["user_id"])


def reminded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers of a stateful processor that the watermark has passed, a day after each purchase; of one millisecond, one."""
    with _rocks_db(spark):
        bought = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts").withWatermark("ts", "1 minute")
        found = bought.groupBy("user_id").transformWithStateInPandas(Reminders(), "user_id long, due long, n long", "Append", "EventTime")
        return run_to_files(found)


def follow(stream: DataFrame, place: str) -> DataFrame:
    """Appends what a stream has new to ``place`` by a run that ends there; the next run of the same place goes on. All rows so far."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{place}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream by a source in Python that follows a table's commits: events, committed in two parts, each read by a run of its own."""
    committed.register(spark)
    path, place = committed.new_place(spark, "events"), committed.new_place(spark, "followed")
    events = table(spark, sf_dir, "events")
    middle = F.col("event_type").isin("click", "view")
    for part in (events.where(middle), events.where(~middle)):
        part.write.format("committed").option("path", path).mode("append").save()
        rows = follow(spark.readStream.format("committed").option("path", path).load(), place)
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined with the left one kept: clicks with their purchases within an hour, or without any once the watermark has passed that hour."""
    clicks = event_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked")).withWatermark("clicked", "10 minutes")
    bought = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "ts").withWatermark("ts", "10 minutes")
    soon = F.expr("user_id = u AND ts >= clicked AND ts <= clicked + INTERVAL 1 HOUR")
    return run_to_files(clicks.join(bought, soon, "left_outer").select("click_id", F.col("event_id").alias("purchase_id")))


class LastPurchases(StatefulProcessor):
    """The last KEPT purchases of a user as a list, and their number and sum by day as a map, both of which expire."""

    KEPT = 3

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "ts long, event_id long, value double", self.ttl_ms)
        self.days = handle.getMapState("days", "day int", "n long, top double", self.ttl_ms)

    def handleInputRows(self, key, rows, timers):  # noqa: N802  Spark's name
        held = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        # A call to the state store costs more than the rows of a day: the map is read once and only changed days are written.
        every = {k[0]: tuple(v) for k, v in self.days.iterator()} if self.days.exists() else {}
        changed: set[int] = set()
        for batch in rows:
            at, events, values, days = (batch[c].tolist() for c in ("at", "event_id", "value", "day"))
            held = sorted(held + list(zip(at, events, values, strict=True)))[-self.KEPT :]
            for day, value in zip(days, values, strict=True):
                n, top = every.get(day, (0, float("-inf")))
                every[day] = n + 1, max(top, value)
            changed.update(days)
        self.last.put(held)
        for day in changed:
            self.days.updateValue((day,), every[day])
        every = [(day, *v) for day, v in every.items()]
        busiest = max(every, key=lambda d: (d[1], -d[0]))
        yield pd.DataFrame({"user_id": [key[0]], "last": [[e for _, e, _ in reversed(held)]], "total": [float(sum(v for *_, v in held))], "days": [len(every)], "busiest": [busiest[0]], "most": [busiest[1]]})

    def close(self) -> None:
        pass


def purchases_kept(events: DataFrame, ttl_ms: int | None, place: str | None = None) -> DataFrame:
    """What LastPurchases keeps of each user's purchases in a stream of events, after a run of one batch."""
    bought = events.where("event_type = 'purchase'").select("user_id", F.unix_micros("ts").alias("at"), "event_id", "value", F.dayofmonth("ts").alias("day"))
    shape = "user_id long, last array<long>, total double, days int, busiest int, most long"
    found = bought.groupBy("user_id").transformWithStateInPandas(LastPurchases(ttl_ms), shape, "Update", "ProcessingTime" if ttl_ms else "None")
    return run_by_batch(found, ["user_id"], place=place, once=True)


def last_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last three purchases, and the day of the month with most, from list and map state that a day without use would clear."""
    with _rocks_db(spark):
        rows = purchases_kept(event_stream(spark, sf_dir), 86_400_000)
    return rows.select("user_id", F.array_join("last", ",").alias("last"), F.round("total", 4).alias("total"), "days", "busiest", "most")


QUERIES = {f"stream_{f.__name__}": f for f in (tumbling, hopping, sessions, deduplicated, enriched, paired, stateful, timed_out, running, late_dropped, transformed, reminded, custom_source, unpaired, last_purchases)}
ORACLE_SQL = {
    "stream_tumbling": """
        SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2
        HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_hopping": """
        SELECT b AS begin, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS bought
        FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1
        HAVING b + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_timed_out": """
        SELECT user_id, count(*) AS n, make_timestamp(epoch_us(max(ts)) // 1000 * 1000) AS last FROM events GROUP BY 1
        HAVING epoch_us(max(ts)) // 1000 + 2 * 86400000 < epoch_us((SELECT max(ts) + INTERVAL 1 HOUR - INTERVAL 1 MINUTE FROM events)) // 1000""",
    "stream_reminded": """
        WITH p AS (SELECT user_id, epoch_us(ts) // 1000 + 86400000 AS due FROM events WHERE event_type = 'purchase')
        SELECT user_id, due, any_value(k) AS n FROM p JOIN (SELECT user_id, count(*) AS k FROM p GROUP BY 1) USING (user_id)
        WHERE due <= (SELECT max(due) - 86400000 - 60000 FROM p) GROUP BY 1, 2""",
    "stream_custom_source": "SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL",
    "stream_unpaired": """
        WITH w AS (
            SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'purchase')) AS seen FROM events)
        SELECT c.event_id AS click_id, p.event_id AS purchase_id
        FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
        ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
        WHERE p.event_id IS NOT NULL OR make_timestamp(epoch_us(c.ts) // 1000 * 1000) + INTERVAL 1 HOUR < (SELECT make_timestamp(epoch_us(seen) // 1000 * 1000) - INTERVAL 10 MINUTE FROM w)""",
    "stream_last_purchases": """
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CAST(day(ts) AS INTEGER) AS day FROM events WHERE event_type = 'purchase'),
        d AS (SELECT user_id, day, count(*) AS n FROM p GROUP BY ALL),
        b AS (SELECT user_id, CAST(count(*) AS INTEGER) AS days, arg_min(day, struct_pack(a := -n, b := day)) AS busiest, max(n) AS most FROM d GROUP BY user_id)
        SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS last, round(sum(value) FILTER (r <= 3), 4) AS total,
               any_value(days) AS days, any_value(busiest) AS busiest, any_value(most) AS most
        FROM p JOIN b USING (user_id) GROUP BY user_id""",
    "stream_sessions": """
        WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM events
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
        SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_deduplicated": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_enriched": """
        SELECT event_id, user_id, c_mktsegment, value FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'""",
    "stream_paired": """
        SELECT c.event_id AS click_id, p.event_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts
        AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
    "stream_stateful": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
    "stream_running": "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
    "stream_late_dropped": """
        SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2
        HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_transformed": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
}
