from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import check, connect
from pyspark.sql import functions as F

from tidewheel.llm import source_mix as sm
from tidewheel.session import table


def plain_targets(sizes, weights, cap=3):
    """{source: words}, {source: weight} -> {source: target}, exactly."""
    clamped: dict = {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = sum(sizes.values()) - sum(clamped.values())
        if not free:
            return clamped
        level = Fraction(left, sum(weights[s] for s in free))
        over = [s for s in free if level * weights[s] > cap * sizes[s]]
        if not over:
            return clamped | {s: level * weights[s] for s in free}
        clamped |= {s: Fraction(cap * sizes[s]) for s in over}


def checked(rows, weights=(1, 2, 3)):
    """Checks (doc_id, source, size, source_size, target, repetitions) of a mix."""
    sizes = defaultdict(int)
    for _, source, size, *_ in rows:
        sizes[source] += size
    order = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s))) + [None] * (None in sizes)
    want = plain_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for _, source, size, source_size, target, times in rows:
        assert source_size == sizes[source] and target == pytest.approx(float(want[source]))
        assert 0 <= times <= 3
        taken[source] += size * times
        largest[source] = max(largest[source], size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def mixed(docs, **params):
    sized, plan = sm.mix(docs, **params)
    return sorted(map(tuple, sm.repetitions(sized, plan).select("doc_id", "source", "size", "source_size", "target", "repetitions").collect()), key=repr)


def test_against_sql(spark, sf_dir):
    check(sm.op9_source_mix(spark, sf_dir), connect(sf_dir), sm.ORACLE_SQL["op9_source_mix"])


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    first = mixed(docs)
    checked(first)
    assert mixed(docs.repartition(7)) == first
    assert mixed(docs, seed="other") != first
    copies = sm.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {r[0]: r[5] for r in first if r[5]}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "B", "é", "zz", None]), st.integers(0, 40)), min_size=1, max_size=40))
def test_any_sizes(spark, rows):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    if sum(n for _, n in rows):
        checked(mixed(docs))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 50_000, None), (None, "one two", "a"), (3, "x y", None), (3, "x y", None), (7, "\x0b a\tb\r", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "target": F.lit(0), "order_key": F.lit("x")})
    assert sorted((r[0] or 0, r[2]) for r in mixed(docs)) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2), (3, 50_000), (7, 2)]
    assert mixed(docs.limit(0)) == [] and sm.mixed_documents(docs.limit(0)).count() == 0
    assert sm.mixed_documents(docs).columns == docs.columns


def test_equal_rows_are_taken_one_by_one(spark, tmp_path):
    rows = [(None, "a b c d e f g h i j", "x")] * 100 + [(5, "one two", "y")] * 30 + [(k, "w " * (k % 7), "y") for k in range(40)] + [(None, "v " * 9, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixed(docs)
    checked(first)
    assert mixed(docs.repartition(5)) == first
    for given in (docs, docs.repartition(7)):
        copies = sm.mixed_documents(given).groupBy("doc_id", "text", "source").count().collect()
        want = defaultdict(int)
        for i, source, size, _, _, times in first:
            want[i, source, size] += times
        assert {(r["doc_id"], r["source"], len(r["text"].split())): r["count"] for r in copies} == {k: n for k, n in want.items() if n}
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    check(sm.op9_source_mix(spark, str(tmp_path)), connect_documents(tmp_path), sm.ORACLE_SQL["op9_source_mix"])


def connect_documents(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con
