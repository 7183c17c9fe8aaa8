"""Joins: hash, sort-merge and broadcast as Spark picks them, and the ones Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table, views
from tidewheel.storage import cut


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """An inner join whose large side may have a third of its rows under one key.

    The large side's rows of a key are dealt to ``salts`` groups by a hash of the row, and
    the small side's rows are repeated to all of them. small must be unique by the key.
    """
    salt = F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return large.withColumn("salt_", salt).join(small.withColumn("salt_", every), [key, "salt_"]).drop("salt_")


def interval_join(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of points and spans with begin <= at < end, as an equi-join on blocks of time.

    Time is cut into buckets of ``width`` seconds, and those into blocks of 1, 2, 4 ... of
    them. A span of any length is covered by at most two blocks of each size, and a point asks
    for its block of every size that some span uses: rows are repeated as often as there are
    sizes, whatever the spans' lengths, and a point meets a span at one block only. Times are
    timestamps without zone. Null times, empty spans and spans that end before they begin meet
    nothing; null values of ``on`` meet nothing.
    """
    bucket = lambda c: F.floor(_seconds(F.col(c)) / width)
    covered = spans.where(F.col(begin) < F.col(end)).withColumns({"lo_": bucket(begin), "hi_": bucket(end)})
    covered = covered.withColumn("block_", F.explode(_cover(F.col("lo_"), F.col("hi_")))).drop("lo_", "hi_")
    sizes = [r[0] for r in covered.select("block_.size").distinct().collect()]  # SIZES at most
    asked = F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright(bucket(at), k).alias("block")) for k in sizes])
    met = points.withColumn("block_", F.explode(asked if sizes else F.array().cast("array<struct<size:int,block:bigint>>"))).join(covered.hint("merge"), [*(on or []), "block_"])
    return met.where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("block_")


#: Sizes of blocks, powers of two: the largest is longer than all time in buckets of a second.
SIZES = 52


def _cover(lo: Column, hi: Column) -> Column:
    """Blocks (size, block) that cover the buckets lo to hi, each once: of every size those whose double is not covered."""
    right = lambda c, k: F.call_function("shiftright", c, k)

    def of_size(k: Column) -> Column:
        first = right(lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        last = right(hi + 1, k) - 1
        block = lambda b: F.struct(k.alias("size"), b.alias("block"))
        return F.array(F.when((first <= last) & (first % 2 != 0), block(first)), F.when((first <= last) & (last % 2 == 0), block(last)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), of_size)))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, order: str, values: list[str], width: int) -> DataFrame:
    """left with the values of the latest right row of the same key at or before each row's time.

    Both sides go through one shuffle by key and bucket of ``width`` seconds, in which a
    window carries the latest right row forward; what a bucket starts with comes from the
    buckets' own last rows. No pair is formed, and a key with very many rows is spread over
    its buckets. order breaks ties between right rows of one time.

    Left rows with a null key or time find nothing and stay, with null values; right ones
    are found by none.
    """
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    kinds = {f.name: f.dataType for f in right.schema}
    apart = left.where(~known).select("*", *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    left, right = left.where(known), right.where(known)
    told = F.struct(F.col(at).alias("at_"), F.col(order).alias("order_"), *values)
    empty = F.lit(None).cast(right.select(told.alias("t")).schema["t"].dataType)
    rows = left.select(key, F.col(at).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"), empty.alias("told_"))
    news = right.select(key, F.col(at).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(rows.schema["row_"].dataType).alias("row_"), told.alias("told_"))
    both = rows.unionByName(news).withColumn("bucket_", F.floor(_seconds(F.col("t_")) / width))
    inside = Window.partitionBy(key, "bucket_").orderBy("t_", "side_", "told_.order_").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(key, "bucket_").agg(F.max("told_").alias("end_"))
    ends = ends.select(key, "bucket_", F.last("end_", ignorenulls=True).over(before).alias("carried_"))
    filled = both.withColumn("found_", F.last("told_", ignorenulls=True).over(inside)).join(ends, [key, "bucket_"])
    found = F.coalesce("found_", "carried_")
    return filled.where("side_ = 1").select("row_.*", *[found[v].alias(v) for v in values]).unionByName(apart)


def _bucket(c: Column, edges: list[float]) -> Column:
    """The number of edges at or below a double, of 2 ** n - 1 ascending ones, by halving."""
    held = F.lit(edges)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((len(edges) + 1).bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.element_at(held, found + step) <= c, found + step).otherwise(found))


def inequality_join(left: DataFrame, right: DataFrame, less: tuple[str, str], more: tuple[str, str], levels: int = 8) -> DataFrame:
    """Pairs of rows with left.less[0] < right.less[1] and left.more[0] > right.more[1], without a nested loop.

    Each of the two comparisons is cut into 2 ** levels ranges of about equal numbers of rows.
    Of two rows in different ranges one is in the lower and one in the upper half of exactly
    one range of ranges, so each row stands in one such place a level, on the side its value
    allows, and pairs meet by equality of places: all of them are results, except those of
    rows in one and the same range, which are compared. A row is repeated (levels / 2 + 1) ** 2
    times on average, whatever it meets, and work beyond that goes with the result.

    Columns must differ in name; they are numbers or timestamps without zone. Nulls and NaN
    meet nothing; equal values are neither less nor more.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)).cast("double")
    sides = [(left, less[0], more[0]), (right, less[1], more[1])]
    valid = []
    for df, a, b in sides:
        there = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"a_": number(a), "b_": -number(b)})
        valid.append(there.where(~F.isnan("a_") & ~F.isnan("b_")))
    shares = [k / (1 << levels) for k in range(1, 1 << levels)]
    both = valid[0].select("a_", "b_").union(valid[1].select("a_", "b_"))
    edges = both.agg(*[F.percentile_approx(c, shares, 100 << levels).alias(c) for c in ("a_", "b_")]).first()

    def places(c: str, bit: int) -> Column:
        if not edges[c]:  # no rows
            return F.array(F.lit(0).cast("long"))
        bucket = F.col(f"{c}bucket")
        level = lambda k: F.when(F.shiftright(bucket, k).bitwiseAND(F.lit(1)) == bit, F.lit(k + 1).cast("long") * (1 << 32) + F.shiftright(bucket, k + 1))
        return F.array_compact(F.array(bucket.cast("long"), *[level(k) for k in range(levels)]))

    placed = []
    for bit, df in enumerate(valid):
        df = df.withColumns({f"{c}bucket": _bucket(F.col(c), edges[c] or [0.0]) for c in ("a_", "b_")})
        df = df.withColumn("x_", F.explode(places("a_", bit))).withColumn("y_", F.explode(places("b_", bit)))
        placed.append(df.drop("a_", "b_", "a_bucket", "b_bucket"))
    # Spark takes a side's size from before it was repeated, and would broadcast it by that.
    met = placed[0].join(placed[1].hint("merge"), ["x_", "y_"]).where((F.col(less[0]) < F.col(less[1])) & (F.col(more[0]) > F.col(more[1])))
    return met.select(*left.columns, *right.columns)


def _ranks(values: DataFrame, value: str) -> DataFrame:
    """(value, rank_): the place of each distinct value in their order, from 0, by a range partitioning."""
    dealt = cut(values.select(value).distinct().repartitionByRange(value).select(value, F.spark_partition_id().alias("part_")), "ranks")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("ahead_"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(value)) - 1
    return dealt.withColumn("at_", inside).join(parts, "part_").select(value, (F.col("at_") + F.col("ahead_")).alias("rank_"))


def inequality_totals(left: DataFrame, right: DataFrame, less: tuple[str, str], more: tuple[str, str], value: str, levels: int = 10) -> DataFrame:
    """right's rows with n, top and least: how many left rows have left.less[0] < right.less[1] and left.more[0] > right.more[1], their largest left.more[0] and smallest left.value.

    No pair is formed. The first comparison is by ranks of distinct values: of two different
    ones, one is in the lower and one in the upper half of exactly one block of 2, 4, 8 ...
    ranks, so a left row stands in the lower halves that it is in and a right row asks those
    beside its upper ones. There the second comparison is a running total, ordered in 2 **
    levels ranges; what went before a range comes from the ranges' own totals. Rows equal in
    both values are one, so a frequent value is no large group. A row is repeated at most as
    often as there are bits in the number of distinct values.

    Rows of right that no left row goes with are left out. Nulls and NaN go with nothing. What
    the other side's extremes exclude is left out before anything is repeated.
    """
    sides = []
    for df, a, b in ((left, less[0], more[0]), (right, less[1], more[1])):
        there = df.withColumns({"x_": F.col(a), "y_": F.col(b)}).where("x_ IS NOT NULL AND y_ IS NOT NULL")
        for c in ("x_", "y_"):
            there = there.where(~F.isnan(c)) if dict(there.dtypes)[c] in ("double", "float") else there
        sides.append(there)
    low, high = (df.agg(F.min("x_").alias("x0"), F.max("x_").alias("x1"), F.min("y_").alias("y0"), F.max("y_").alias("y1")).first() for df in sides)
    lefts = sides[0].where((F.col("x_") < F.lit(high["x1"])) & (F.col("y_") > F.lit(high["y0"])))
    rights = sides[1].where((F.col("x_") > F.lit(low["x0"])) & (F.col("y_") < F.lit(low["y1"])))
    held = lefts.groupBy("x_", "y_").agg(F.count(F.lit(1)).alias("n_"), F.min(value).alias("least_"))
    asked = rights.select("x_", "y_").distinct()
    ranks = cut(_ranks(lefts.select("x_").union(rights.select("x_")), "x_"), "ranks")
    bits = (ranks.agg(F.max("rank_")).first()[0] or 0).bit_length()
    shares = [k / (1 << levels) for k in range(1, 1 << levels)]
    edges = held.select("y_").union(asked.select("y_")).agg(F.percentile_approx(F.col("y_").cast("double"), shares, 100 << levels).alias("e")).first()["e"] or [0.0]

    def placed(df: DataFrame, bit: int) -> DataFrame:
        rank = F.col("rank_")
        half = lambda k: F.when(F.shiftright(rank, k).bitwiseAND(F.lit(1)) == bit, F.struct(F.lit(k).alias("size"), F.shiftright(rank, k + 1).alias("block")))
        halves = F.array_compact(F.array(*[half(k) for k in range(max(bits, 1))]))
        return df.join(ranks, "x_").withColumns({"range_": _bucket(F.col("y_").cast("double"), edges), "place_": F.explode(halves)})

    totals = (F.sum("n_").alias("n_"), F.max("top_").alias("top_"), F.min("least_").alias("least_"))
    given = placed(held, 0).groupBy("place_", "range_", "y_").agg(F.sum("n_").alias("n_"), F.max("y_").alias("top_"), F.min("least_").alias("least_"))
    both = given.withColumn("side_", F.lit(1)).unionByName(placed(asked, 1).select("place_", "range_", "y_", "x_", F.lit(0).alias("side_")), allowMissingColumns=True)
    both = cut(both, "halves")
    before = Window.partitionBy("place_").orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy("place_", "range_").agg(*totals).select("place_", "range_", *[f(c).over(before).alias(d) for f, c, d in ((F.sum, "n_", "n0_"), (F.max, "top_", "top0_"), (F.min, "least_", "least0_"))])
    inside = Window.partitionBy("place_", "range_").orderBy(F.desc("y_"), "side_").rowsBetween(Window.unboundedPreceding, 0)
    running = both.withColumns({"n_": F.sum("n_").over(inside), "top_": F.max("top_").over(inside), "least_": F.min("least_").over(inside)}).where("side_ = 0")
    met = running.join(ranges, ["place_", "range_"]).groupBy("x_", "y_").agg(
        F.sum(F.coalesce("n_", F.lit(0)) + F.coalesce("n0_", F.lit(0))).alias("n"), F.max(F.greatest("top_", "top0_")).alias("top"), F.min(F.least("least_", "least0_")).alias("least")
    )
    return rights.join(met.where("n > 0"), ["x_", "y_"]).select(*right.columns, "n", "top", "least")


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join of five tables."""
    t = lambda n: table(spark, sf_dir, n)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("r_name") == "ASIA")
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that keeps customers with no matching order, counted by number of orders."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 150000)
    per = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return per.groupBy("n_orders").agg(F.count(F.lit(1)).alias("n_customers"))


def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS as a left semi join."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = table(spark, sf_dir, "orders")
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT EXISTS as a left anti join."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey", "o_orderdate")


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides kept, matched by nation."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers").fillna(0)


def null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls equal to nulls."""
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    e = table(spark, sf_dir, "events").select(kind.alias("kind"), "value")
    a = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    b = e.groupBy(F.col("kind").alias("other")).agg(F.round(F.max("value"), 4).alias("top"))
    return a.join(b, a.kind.eqNullSafe(b.other)).select("kind", "n", "top")


def hot_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on event type, of which there are five, dealt by salt."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    means = events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    met = salted_join(events, means, "event_type", 16)
    return met.groupBy("event_type").agg(F.count_if(F.col("value") > F.col("mean")).alias("above"), F.count(F.lit(1)).alias("n"))


def interval_totals(points: DataFrame, spans: DataFrame, at: str, value: str, key: str, begin: str, end: str, width: int) -> DataFrame:
    """(key, n, total): number and sum of the points with begin <= at < end of each span that has any.

    No pair is formed: a span's totals are those up to its end less those up to its begin.
    Points and both ends of spans are ordered within buckets of ``width`` seconds, and what
    went before a bucket comes from a running sum over buckets, a row each. Values are summed
    as decimals of 12 places, so nothing is lost in differences.

    Points with a null time are in no span, spans with a null end have no points. A value that
    is null, not finite or beyond 1e25 counts as a point and adds nothing.
    """
    exact = F.col(value).cast("double").try_cast("decimal(38,12)")
    points = points.where(F.col(at).isNotNull())
    spans = spans.where(F.col(begin) < F.col(end))
    rows = points.select(F.col(at).alias("t_"), F.lit(1).alias("side_"), exact.alias("v_"), F.lit(None).cast(spans.schema[key].dataType).alias(key))
    for sign, edge in ((-1, begin), (1, end)):  # an end of a span goes before points of its time
        rows = rows.unionByName(spans.select(F.col(edge).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast("decimal(38,12)").alias("v_"), key).withColumn("sign_", F.lit(sign)), allowMissingColumns=True)
    rows = rows.withColumn("bucket_", F.floor(_seconds(F.col("t_")) / width))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where("side_ = 1").groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"), F.sum("v_").alias("s_"))
    sums = rows.select("bucket_").distinct().join(sums, "bucket_", "left").select("bucket_", F.sum("n_").over(before).alias("n0_"), F.sum("s_").over(before).alias("s0_"))
    inside = Window.partitionBy("bucket_").orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"n_": F.sum("side_").over(inside), "s_": F.sum("v_").over(inside)}).where("side_ = 0").join(sums, "bucket_")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,12)"))
    n, total = F.col("n_") + F.coalesce("n0_", F.lit(0)), zero(F.col("s_")) + zero(F.col("s0_"))
    found = running.groupBy(key).agg(F.sum(n * F.col("sign_")).alias("n"), F.sum(F.when(F.col("sign_") > 0, total).otherwise(-total)).cast("double").alias("total"))
    return found.where("n > 0")


def orders_in_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within half an hour after each sign-up, of any user: totals over intervals without their pairs."""
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("ts").alias("begin"), F.expr("ts + INTERVAL 30 MINUTES").alias("end"))
    found = interval_totals(events.where("event_type = 'purchase'"), spans, "ts", "value", "signup", "begin", "end", 3600)
    return found.select("signup", "n", F.round("total", 4).alias("total"))


def clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's clicks of the half hour after which it came: a join on a key and an interval."""
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("begin"), F.expr("ts + INTERVAL 30 MINUTES").alias("end"))
    points = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return interval_join(points, spans, "ts", "begin", "end", 1800, ["user_id"]).select("user_id", "click_id", "event_id")


def lines_by_order_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the order of the same customer during whose time, up to the customer's next order, it was shipped: spans of days to years."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    next_ = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
    spans = orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("during")).select("o_custkey", "during", F.col("o_orderdate").alias("begin"), next_.alias("end"))
    shipped = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    # A customer's spans are disjoint, so the one that a line may be in is the latest begun.
    found = as_of_join(shipped, spans.withColumnRenamed("begin", "l_shipdate"), "o_custkey", "l_shipdate", "during", ["during", "end"], 10 * 366 * 86400)
    return found.where(F.col("l_shipdate") < F.col("end")).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "during")


def dearer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dearer than a whole order that came at least six years after they were shipped: totals of two large sides over two inequalities."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.expr("l_shipdate + INTERVAL 6 YEARS").alias("later"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    met = inequality_totals(line, orders, ("later", "o_orderdate"), ("l_extendedprice", "o_totalprice"), "l_orderkey")
    return met.groupBy("o_orderkey").agg(F.sum("n").alias("n_lines"), F.max("top").alias("dearest"), F.min("least").alias("first_order"))


def shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two large sides where the smaller one's partitions fit in memory: no sort."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    met = line.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side kept: every nation, with its rich customers."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rich"))
    nations = table(spark, sf_dir, "nation")
    return rich.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_name", F.coalesce("rich", F.lit(0)).alias("rich"))


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on an inequality: a nested loop, for sides of a fixed size only (here regions and nations)."""
    views(spark, sf_dir, ["region", "nation"])
    return spark.sql("SELECT r_name, count(*) AS n FROM region JOIN nation ON length(n_name) > length(r_name) AND n_regionkey <> r_regionkey GROUP BY r_name")


def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's latest view."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return as_of_join(bought, viewed, "user_id", "ts", "view_id", ["view_id", "view_value"], 7 * 86400).fillna(-1)


def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest orders of every customer of one segment, by a lateral subquery."""
    views(spark, sf_dir, ["customer", "orders"])
    return spark.sql("""
        SELECT c_custkey, o_orderkey, o_totalprice FROM customer,
        LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
        WHERE c_mktsegment = 'BUILDING'""")


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, which Spark turns into a join with the aggregate."""
    views(spark, sf_dir, ["orders"])
    return spark.sql("""
        SELECT o_orderkey, o_custkey FROM orders o
        WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")


def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN, which keeps nothing where the list has a null.

    Spark's own NOT IN broadcasts the list, whatever its size; here an anti join by the key
    and one row that tells whether the list has a null or is empty.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return not_in_list(part, "p_partkey", listed, "l_partkey")


def not_in_list(rows: DataFrame, key: str, listed: DataFrame, value: str) -> DataFrame:
    """rows whose key is NOT IN listed's values, by SQL's rules for nulls: a null in the list keeps none, a null key only an empty list."""
    told = listed.agg(F.count_if(F.col(value).isNull()).alias("nulls_"), F.count(F.lit(1)).alias("size_"))
    names = rows.columns
    apart = rows.join(listed.where(F.col(value).isNotNull()).distinct(), F.col(key) == F.col(value), "left_anti")
    kept = (F.col("size_") == 0) | (F.col("nulls_") == 0) & F.col(key).isNotNull()
    return apart.join(F.broadcast(told), kept).select(*names)  # told: one row


def same_day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self join on customer and day, each pair of orders once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    a, b = o.alias("a"), o.alias("b")
    same = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, same).select(F.col("a.o_orderkey").alias("one"), F.col("b.o_orderkey").alias("two"), F.col("a.day").cast("string").alias("day"))


QUERIES = {
    f.__name__: f
    for f in (
        revenue_by_nation, orders_per_customer, orders_with_returns, orders_without_lines, full_outer, null_safe, hot_key_join,
        orders_in_campaigns, clicks_before_purchases, lines_by_order_span, dearer_lines, shuffled_hash, right_join, theta_join, last_view_before_purchase, lateral_top, above_average, not_in, same_day_pairs,
    )
}
ORACLE_SQL = {
    "revenue_by_nation": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
    "orders_per_customer": """
        SELECT n_orders, count(*) AS n_customers FROM (
            SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer
            LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey) GROUP BY n_orders""",
    "orders_with_returns": """
        SELECT o_orderpriority, count(*) AS n FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
    "orders_without_lines": """
        SELECT o_orderkey, o_custkey, o_orderdate FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "full_outer": """
        SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM
        (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
        ON c_nationkey = s_nationkey""",
    "null_safe": """
        SELECT nullif(event_type, 'error') AS kind, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1""",
    "hot_key_join": """
        SELECT event_type, count(*) FILTER (WHERE value > mean) AS above, count(*) AS n
        FROM events JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) USING (event_type) GROUP BY event_type""",
    "orders_in_campaigns": """
        SELECT s.event_id AS signup, count(*) AS n, round(sum(p.value), 4) AS total FROM events s JOIN events p
        ON p.ts >= s.ts AND p.ts < s.ts + INTERVAL 30 MINUTE AND p.event_type = 'purchase'
        WHERE s.event_type = 'signup' GROUP BY 1""",
    "clicks_before_purchases": """
        SELECT p.user_id, c.event_id AS click_id, p.event_id FROM events c JOIN events p
        ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts < c.ts + INTERVAL 30 MINUTE
        WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
    "lines_by_order_span": """
        WITH s AS (SELECT o_custkey, min(o_orderkey) AS during, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS b FROM orders GROUP BY o_custkey, o_orderdate)
        SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, during FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
        JOIN s ON s.o_custkey = o.o_custkey AND l_shipdate >= a AND l_shipdate < b""",
    "dearer_lines": """
        SELECT o_orderkey, count(*) AS n_lines, max(l_extendedprice) AS dearest, min(l_orderkey) AS first_order
        FROM lineitem JOIN orders ON l_shipdate + INTERVAL 6 YEAR < o_orderdate AND l_extendedprice > o_totalprice GROUP BY o_orderkey""",
    "shuffled_hash": """
        SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "right_join": """
        SELECT n_name, coalesce(rich, 0) AS rich FROM (SELECT c_nationkey, count(*) AS rich FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
        RIGHT JOIN nation ON c_nationkey = n_nationkey""",
    "theta_join": """
        SELECT r_name, count(*) AS n FROM region JOIN nation ON length(n_name) > length(r_name) AND n_regionkey <> r_regionkey GROUP BY r_name""",
    "last_view_before_purchase": """
        SELECT p.user_id, p.event_id, p.ts, coalesce(v.event_id, -1) AS view_id, coalesce(v.value, -1) AS view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "lateral_top": """
        SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
        ON o_custkey = c_custkey WHERE rn <= 2 AND c_mktsegment = 'BUILDING'""",
    "above_average": """
        SELECT o_orderkey, o_custkey FROM orders o
        WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "not_in": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "same_day_pairs": """
        SELECT a.o_orderkey AS one, b.o_orderkey AS two, CAST(CAST(a.o_orderdate AS DATE) AS VARCHAR) AS day FROM orders a JOIN orders b
        ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AND a.o_orderkey < b.o_orderkey""",
}
