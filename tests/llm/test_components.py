import random

import pytest

from tidewheel.llm.components import components


def plain_roots(links):
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for x, y in links:
        a, b = sorted((find(x), find(y)))
        label[b] = a
    return {i: find(i) for i in label}


def joined_rows(spark, since):
    """Rows that the joins of all queries after the first `since` put out."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    total = 0
    for k in range(since, store.executionsCount()):
        number = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size() if "Join" in node.name() else 0)):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def shuffled(rng, links):
    names = sorted({x for link in links for x in link})
    given = dict(zip(names, rng.sample(range(-(10**9), 10**9), len(names)), strict=True))
    return [(given[x], given[y]) for x, y in rng.sample(links, len(links))]


SHAPES = {
    "none": [],
    "self": [(5, 5), (7, 7), (7, 8), (8, 7), (8, 7)],
    "ascending chain": [(i, i + 1) for i in range(300)],
    "low and high in turn": [(i // 2 + (i % 2) * 1000, (i + 1) // 2 + (1 - i % 2) * 1000) for i in range(300)],
    "star of a high node": [(1000, i) for i in range(200)],
    "stars that share nodes": [(h, random.Random(h).randrange(100, 400)) for h in range(60) for _ in range(3)],
    "random": [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(1, 250)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_roots_are_the_plain_ones(spark, shape):
    rng = random.Random(1)
    for links in (SHAPES[shape], shuffled(rng, SHAPES[shape])):
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in found} == plain_roots(links) and len(found) == len(plain_roots(links))


def test_rounds_join_what_is_left_and_not_all_links_again(spark):
    """Many links over long ways: all rounds together join a few rows a link and node, however many rounds they are."""
    rng = random.Random(2)
    ways = [(k * 1000 + i, k * 1000 + i + step) for k in range(20) for i in range(100) for step in range(1, 11)]
    links = shuffled(rng, ways)
    given = spark.createDataFrame(links, "a long, b long")
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {r["node"]: r["root"] for r in components(given).collect()}
    assert found == plain_roots(links)
    assert joined_rows(spark, since) <= 2 * len(links)
