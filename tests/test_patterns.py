"""Row patterns against a plain backtracking matcher."""

import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators.patterns import Automaton, Matcher, alt, ends, path, rep, seq, unresolved

NAMES = ["A", "B", "C", "ANY"]


def tries(p, rows, k):
    """Every way a pattern can match from row k, preferred first: (end, symbols); the definition."""
    if isinstance(p, str) or p[0] == "sym":
        name = p if isinstance(p, str) else p[1]
        if k < len(rows) and name in rows[k]:
            yield k + 1, [name]
    elif p[0] == "seq":
        if len(p) == 1:
            yield k, []
        else:
            for end, said in tries(p[1], rows, k):
                for last, more in tries(("seq", *p[2:]), rows, end):
                    yield last, said + more
    elif p[0] == "alt":
        for part in p[1:]:
            yield from tries(part, rows, k)
    else:
        _, part, least, most, greedy = p
        ends = [] if least > 0 else [(k, [])]

        def more():
            if most is None or most > 0:
                for end, said in tries(part, rows, k):
                    if end > k or least > 0:
                        for last, rest in tries(("rep", part, max(least - 1, 0), None if most is None else most - 1, greedy), rows, end):
                            yield last, said + rest

        if greedy:
            yield from more()
            yield from ends
        else:
            yield from ends
            yield from more()


def plain(rows, p, overlap):
    """[(first row, symbols)] of the matches of one key's rows (sets of conditions)."""
    out, k = [], 0
    while k < len(rows):
        end, said = next(tries(p, rows, k), (k, []))
        if end > k:
            out.append((k, said))
        k = k + 1 if overlap or end == k else end
    return out


PATTERNS = [
    seq("A", rep("B"), "C"),
    seq("A", rep("B", 0), rep("C", 0, 1)),
    rep(alt(seq("A", "B"), "A", seq("B", "C", "C")), 1),
    seq("A", rep("ANY", 0, greedy=False), "C"),
    seq("A", rep("ANY", 0), "C"),
    seq(rep("A", 2, 3), rep(alt("B", "C"), 1, 2, greedy=False), "ANY"),
    alt(seq("A", "A", "A", "A", "B"), "A"),
    rep(rep("A", 0), 0),
    seq(rep(alt("A", rep("B", 0)), 0), "C"),
]


def made(seed, n):
    rng = random.Random(seed)
    return [frozenset({rng.choice("AABC"), "ANY"} | ({rng.choice("ABC")} if rng.random() < 0.2 else set())) for _ in range(n)]


def test_choices_are_ordered():
    greedy, lazy = (Automaton(rep("A", 0, greedy=g), NAMES).choices for g in (True, False))
    assert greedy[0] == [(0, 1), None] and lazy[0] == [None, (0, 1)]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_ends_and_paths(pattern):
    """In one piece and through many, without Spark."""
    choices = Automaton(pattern, NAMES).choices
    for seed in range(20):
        rows = made(seed, 30)
        masks = [sum(1 << k for k, c in enumerate(NAMES) if c in r) for r in rows]
        behind = [29 if None in options else -1 for options in choices]
        found = ends(choices, masks, 0, behind)
        said = dict(plain(rows, pattern, True))
        for k in range(30):
            if k in said:
                assert found[k][0] == k + len(said[k]) - 1 and [NAMES[s] for _, s, _ in path(choices, masks, found, k, 0)] == said[k]
            else:
                assert found[k][0] < k
        front = behind
        for begin in range(25, -1, -5):
            tries = unresolved(choices, masks[begin : begin + 5], begin)
            front = [next((e for e in (t if t >= 0 or begin == 0 and t == -1 else front[-2 - t] for t in own) if e != -1), -1) for own in tries]
            assert [e for e in front if e >= begin] == [e for e in found[begin] if e >= begin]


@pytest.mark.parametrize(("pattern", "bits"), [(PATTERNS[0], 1), (PATTERNS[3], 1), (PATTERNS[5], 2), (PATTERNS[8], 12)])
def test_against_backtracking(spark, pattern, bits):
    keys = {None: made(1, 23), "a": made(2, 40), "b": made(3, 1), "": made(4, 12)}
    rows = [(key, k, [c in r for c in NAMES], "x") for key, own in keys.items() for k, r in enumerate(own)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, n long, met array<boolean>, symbol_ string").repartition(3)
    conditions = {c: F.col("met")[k] for k, c in enumerate(NAMES)}
    m = Matcher(df, ["key"], ["n"], conditions, pattern, piece_bits=bits)
    every = sorted(((r["key"], r["n"], r["n_rows"]) for r in m.every().collect()), key=repr)
    assert every == sorted(((key, k, len(said)) for key, own in keys.items() for k, said in plain(own, pattern, True)), key=repr)
    matches = {}
    for r in sorted(m.apart().collect(), key=lambda r: r["n"]):
        matches.setdefault((r["key"], r["match"]), []).append((r["n"], r["symbol"]))
    want = [(key, [(k + j, s) for j, s in enumerate(said)]) for key, own in keys.items() for k, said in plain(own, pattern, False)]
    assert sorted(((key, own) for (key, _), own in matches.items()), key=repr) == sorted(want, key=repr)


def test_hot_key_and_nothing(spark):
    own = made(7, 3000)
    df = spark.createDataFrame([(1, k, sorted(r)) for k, r in enumerate(own)], "key int, n int, met array<string>")
    conditions = {c: F.array_contains("met", c) for c in NAMES}
    pattern = seq("A", rep("ANY", 0, greedy=False), "C", "C", "C")
    found = Matcher(df, ["key"], ["n"], conditions, pattern, piece_bits=4).apart()
    assert {r["n"] for r in found.collect()} == {k + j for k, said in plain(own, pattern, False) for j in range(len(said))}
    assert Matcher(df.limit(0), ["key"], ["n"], conditions, pattern).apart().count() == 0
    assert Matcher(df, ["key"], ["n"], conditions | {"A": F.lit(None).cast("boolean")}, pattern).every().count() == 0


def test_matches_that_end_with_a_partition(spark):
    """Ends at the last row that a partition has of a key that goes on in the next one."""
    own = [frozenset({"AC"[k % 2], "ANY"}) for k in range(2000)]
    df = spark.createDataFrame([(1, k, sorted(r)) for k, r in enumerate(own)], "key int, n int, met array<string>").repartition(4)
    conditions = {c: F.array_contains("met", c) for c in NAMES}
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        for pattern in (seq("A", "C"), seq("C", "A")):
            m = Matcher(df, ["key"], ["n"], conditions, pattern, piece_bits=4)
            said = plain(own, pattern, True)
            assert sorted((r["n"], r["n_rows"]) for r in m.every().collect()) == [(k, 2) for k, _ in said]
            assert {r["n"] for r in m.apart().collect()} == {k + j for k, own_ in plain(own, pattern, False) for j in range(len(own_))}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
