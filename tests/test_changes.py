"""Merges, histories and reachability against plain definitions."""

import random

from pyspark.sql import functions as F

from tidewheel.operators import changes, windows

SHAPE = "k int, v string, op string, at int, seq int"


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2, 3, *range(30)]), f"v{rng.randrange(9)}", rng.choice(["upsert", "upsert", "delete"]), rng.randrange(40), k) for k in range(n)]


def test_merge(spark):
    current = [(k, f"c{k}") for k in range(0, 30, 2)]
    rows = made(1, 60)
    found = changes.merged(spark.createDataFrame(current, "k int, v string"), spark.createDataFrame(rows, SHAPE), "k")
    want = dict(current)
    for k, v, op, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[3:]):
        want.pop(k, None)
        if op != "delete":
            want[k] = v
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    assert changes.merged(spark.createDataFrame(current, "k int, v string"), spark.createDataFrame([], SHAPE), "k").count() == len(current)


def test_history_over_batches(spark):
    history = spark.createDataFrame([(k, f"c{k}", -1, None) for k in range(0, 30, 2)], "k int, v string, valid_from int, valid_to int")
    every = [(k, f"c{k}", "upsert", -1, -1) for k in range(0, 30, 2)]
    for n in range(3):
        rows = [(k, v, op, at + 50 * n, seq) for k, v, op, at, seq in made(n, 300)] + [(5, f"hot{i}", "upsert", 50 * n + i % 50, 1000 + i) for i in range(400)]
        every += rows
        history = changes.historied(history, spark.createDataFrame(rows, SHAPE).repartition(5), "k")
    want = []
    for k in {r[0] for r in every} - {None}:
        own = sorted((r for r in every if r[0] == k), key=lambda r: r[3:])
        for r, after in zip(own, [*own[1:], None]):
            if r[2] != "delete" and (after is None or after[3] > r[3]):
                want.append((k, r[1], r[3], after and after[3]))
    assert sorted(map(tuple, history.collect()), key=repr) == sorted(want, key=repr)


def test_reached(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(3, None), (None, 4)] + [(7, k) for k in range(100, 160)]
    found = changes.reached(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(1,), (7,), (None,)], "node int"))
    want, delta, hops = {1: 0, 7: 0}, {1, 7}, 0
    while delta:
        hops += 1
        delta = {b for a, b in edges if a in delta and b is not None} - set(want)
        want |= dict.fromkeys(delta, hops)
    assert {r["node"]: r["hops"] for r in found.collect()} == want


def test_sliding_distinct(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 1, 2, None]), rng.randrange(300), rng.choice(["a", "b", "c", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, u int, t int, kind string").withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    found = windows.sliding_distinct(df, "u", "at", "kind", 20, 30)
    assert {r["id"]: r["n_distinct"] for r in found.collect()} == {i: len({k for _, v, s, k in rows if v == u and t - 20 < s <= t and k is not None}) for i, u, t, _ in rows}
    from tidewheel.plans.inspect import text

    assert "collect_set" not in text(found)


def test_rounds_broadcast_nothing(spark, monkeypatch):
    from tidewheel.plans.inspect import nodes

    plans, cut = [], changes.cut
    monkeypatch.setattr(changes, "cut", lambda df, label: (plans.append(nodes(df)), cut(df, label))[1])
    changes.reached(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), spark.createDataFrame([(1,)], "node int"))
    assert len(plans) == 5 and not any(p["BroadcastHashJoin"] or p["BroadcastExchange"] for p in plans)
