"""The joins Spark has no operator for, against plain definitions."""

import datetime as dt
import math
import random
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, joins
from tidewheel.plans.inspect import nodes

DAY = dt.datetime(2024, 1, 1)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
moments = st.integers(0, 60).map(lambda m: DAY + dt.timedelta(minutes=m))
maybe = st.none() | moments
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), maybe), max_size=12)


@quick
@given(rows, rows, st.sampled_from([60, 600, 86400]))
def test_as_of(spark, left, right, width):
    lefts = [(k, t, n) for n, (k, t) in enumerate(left)]
    rights = [(k, t, n) for n, (k, t) in enumerate(right)]
    l = spark.createDataFrame(lefts, "k string, t timestamp_ntz, id int")
    r = spark.createDataFrame(rights, "k string, t timestamp_ntz, n int")
    found = sorted((x["id"], x["value"]) for x in joins.as_of_join(l, r.withColumn("value", r.n), "k", "t", "n", ["value"], width).select("id", "value").collect())
    want = []
    for k, t, i in lefts:
        before = [(u, n) for j, u, n in rights if None not in (k, t, u) and j == k and u <= t]
        want.append((i, max(before)[1] if before else None))
    assert found == want  # every left row, also those without key or time


@quick
@given(st.lists(maybe, max_size=10), st.lists(st.tuples(moments, st.integers(-5, 50)), max_size=10), st.sampled_from([1, 60, 900]))
def test_interval(spark, points, spans, width):
    p = spark.createDataFrame([(n, t) for n, t in enumerate(points)], "p int, t timestamp_ntz")
    ends = [(n, a, a + dt.timedelta(minutes=m)) for n, (a, m) in enumerate(spans)]
    s = spark.createDataFrame(ends, "s int, a timestamp_ntz, b timestamp_ntz")
    found = sorted((r["p"], r["s"]) for r in joins.interval_join(p, s, "t", "a", "b", width).collect())
    assert found == sorted((i, n) for i, t in enumerate(points) for n, a, b in ends if t and a <= t < b)


def test_salted(spark):
    large = spark.createDataFrame([("hot" if n % 3 else f"k{n}", n) for n in range(300)], "k string, n int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "k string, v int")
    want = sorted(map(tuple, large.join(small, "k").select("k", "n", "v").collect()))
    assert sorted(map(tuple, joins.salted_join(large, small, "k", 7).select("k", "n", "v").collect())) == want


@quick
@given(st.lists(st.tuples(maybe, st.sampled_from([None, 0.25, 1e16, 3.0, float("nan"), float("inf"), 0.1])), max_size=12), st.lists(st.tuples(moments, st.integers(-5, 50)), max_size=10), st.sampled_from([60, 900, 86400]))
def test_interval_totals(spark, points, spans, width):
    p = spark.createDataFrame(points, "t timestamp_ntz, v double")
    ends = [(n, a, a + dt.timedelta(minutes=m)) for n, (a, m) in enumerate(spans)]
    s = spark.createDataFrame(ends, "s int, a timestamp_ntz, b timestamp_ntz")
    found = {r["s"]: (r["n"], r["total"]) for r in joins.interval_totals(p, s, "t", "v", "s", "a", "b", width).collect()}
    points = [(t, v) for t, v in points if t]
    finite = lambda v: v is not None and math.isfinite(v)
    want = {n: (sum(a <= t < b for t, _ in points), float(sum(Decimal(repr(v)) for t, v in points if a <= t < b and finite(v)))) for n, a, b in ends}
    assert found == {n: x for n, x in want.items() if x[0]}


def test_not_in_by_the_rules_for_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    for listed in ([], [(2,), (2,)], [(3,)], [(None,)], [(1,), (None,)]):
        values = spark.createDataFrame(listed, "v int")
        rows.createOrReplaceTempView("rows_")
        values.createOrReplaceTempView("values_")
        want = sorted(map(tuple, spark.sql("SELECT k FROM rows_ WHERE k NOT IN (SELECT v FROM values_)").collect()), key=repr)
        assert sorted(map(tuple, joins.not_in_list(rows, "k", values, "v").collect()), key=repr) == want


def test_exact_quantiles(spark):
    values = [("a", float(v)) for v in (5, 1, 4, 2, 3, 3)] + [("b", 7.0), (None, 1.0), (None, 2.0), ("a", None)]
    found = aggregates.exact_quantiles(spark.createDataFrame(values, "g string, v double"), "g", "v", {"low": 0.1, "mid": 0.5, "top": 1.0})
    assert {r["g"]: (round(r["low"], 9), r["mid"], r["top"]) for r in found.collect()} == {"a": (1.5, 3.0, 5.0), "b": (7.0, 7.0, 7.0), None: (1.1, 1.5, 2.0)}


def test_spans_from_minutes_to_years(spark):
    rng = random.Random(1)
    at = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randrange(-400_000_000, 400_000_000))
    points = [(n, at()) for n in range(400)]
    spans = [(n, a := at(), a + dt.timedelta(seconds=rng.choice([60, 3600, 86400, 10**7, 3 * 10**8]))) for n in range(300)]
    p, s = spark.createDataFrame(points, "p int, t timestamp_ntz"), spark.createDataFrame(spans, "s int, a timestamp_ntz, b timestamp_ntz")
    found = sorted((r["p"], r["s"]) for r in joins.interval_join(p, s, "t", "a", "b", 60).collect())
    assert found == sorted((i, n) for i, t in points for n, a, b in spans if a <= t < b)
    lo, hi = (F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 60) for c in "ab")
    blocks = s.select(F.size(joins._cover(lo, hi)).alias("n"), (hi - lo).alias("width")).collect()
    assert all(r["n"] <= 2 * math.log2(r["width"] + 2) + 2 for r in blocks)  # years are millions of minutes


@quick
@given(st.lists(st.tuples(st.none() | st.integers(-3, 9), st.none() | st.sampled_from([0.5, 1.0, 2.5, float("nan"), float("inf"), -1.0])), max_size=25), st.lists(st.tuples(st.none() | st.integers(-3, 9), st.none() | st.sampled_from([0.5, 1.0, 2.0, float("nan"), -2.0])), max_size=25), st.sampled_from([1, 3, 8]))
def test_inequality(spark, left, right, levels):
    l = spark.createDataFrame([(n, *r) for n, r in enumerate(left)], "i int, a long, b double")
    r = spark.createDataFrame([(n, *r) for n, r in enumerate(right)], "j int, c long, d double")
    found = joins.inequality_join(l, r, ("a", "c"), ("b", "d"), levels)
    ok = lambda *v: all(x is not None and not math.isnan(x) for x in v)
    want = sorted((i, j) for i, (a, b) in enumerate(left) for j, (c, d) in enumerate(right) if ok(a, b, c, d) and a < c and b > d)
    assert sorted((x["i"], x["j"]) for x in found.collect()) == want


def test_inequality_compares_few_pairs(spark):
    rng = random.Random(2)
    l = spark.createDataFrame([(rng.random(), rng.random()) for _ in range(3000)], "a double, b double")
    r = spark.createDataFrame([(rng.random() - 0.97, rng.random()) for _ in range(3000)], "c double, d double")
    met = joins.inequality_join(l, r, ("a", "c"), ("b", "d"))
    assert not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(nodes(met))
    want = l.crossJoin(r).where("a < c and b > d").count()
    assert met.count() == want


@quick
@given(st.lists(st.tuples(st.none() | st.integers(-3, 9), st.none() | st.sampled_from([0.5, 1.0, 2.5, float("nan"), float("inf"), -1.0])), max_size=25), st.lists(st.tuples(st.none() | st.integers(-3, 9), st.none() | st.sampled_from([0.5, 1.0, 2.0, float("nan"), -2.0])), max_size=25), st.sampled_from([1, 3]))
def test_inequality_totals(spark, left, right, levels):
    l = spark.createDataFrame([(n, *r) for n, r in enumerate(left)], "i int, a long, b double")
    r = spark.createDataFrame([(n, *r) for n, r in enumerate(right)], "j int, c long, d double")
    found = {x["j"]: (x["n"], x["top"], x["least"]) for x in joins.inequality_totals(l, r, ("a", "c"), ("b", "d"), "i", levels).collect()}
    ok = lambda *v: all(x is not None and not math.isnan(x) for x in v)
    want = {}
    for j, (c, d) in enumerate(right):
        met = [(b, i) for i, (a, b) in enumerate(left) if ok(a, b, c, d) and a < c and b > d]
        if met:
            want[j] = (len(met), max(b for b, _ in met), min(i for _, i in met))
    assert found == want


def test_inequality_totals_of_equal_rows(spark):
    """Four thousand rows on each side, which are some ten million pairs, are six different ones."""
    line = spark.range(4000).select(F.lit(1).alias("a"), (F.col("id") % 3 + 2.0).alias("b"), "id")
    orders = spark.range(4000).select(F.lit(2).alias("c"), (F.col("id") % 2 + 1.0).alias("d"), F.col("id").alias("j"))
    found = joins.inequality_totals(line, orders, ("a", "c"), ("b", "d"), "id")
    assert {(r["n"], r["top"], r["least"]) for r in found.collect()} == {(4000, 4.0, 0), (2666, 4.0, 1)}
    assert found.count() == 4000


def test_repeated_rows_are_not_broadcast(spark):
    l, r = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b")), spark.range(10).select(F.col("id").alias("c"), F.col("id").alias("d"))
    assert not nodes(joins.inequality_join(l, r, ("a", "c"), ("b", "d")))["BroadcastHashJoin"]
