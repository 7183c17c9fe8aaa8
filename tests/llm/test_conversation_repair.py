import hashlib
import random
import zlib
from functools import cache

import duckdb
import pytest
from oracle import check, connect

from tidewheel.llm import conversation_repair as cr
from tidewheel.llm import earley
from tidewheel.session import table

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(kinds):
    """(cost, audit, roles) by trying every edit at every row: the definition."""

    @cache
    def best(k, state, inserts):
        out = [(0, "", "")] if k == len(kinds) and state in "0a" else []
        to = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 3:
            c, a, r = best(k, to, inserts + 1)
            out.append((c + 5, "I" + a, to + r))
        if k < len(kinds):
            kind = kinds[k]
            c, a, r = best(k + 1, state, 0)
            out.append((c + 2, "D" + a, "-" + r))
            if kind != "x":
                for role in "sua":
                    if role == to or (role == "s" and state == "0"):
                        keeps = kind.lower() == role
                        if keeps or role != "s":
                            c, a, r = best(k + 1, role, 0)
                            out.append((c + (not keeps) + 5 * kind.isupper(), "RK"[keeps] + a, role + r))
        return min(out, default=(10**9, "", ""))

    return best(0, "0", 0)


def test_parser_against_all_edits():
    rng = random.Random(1)
    for _ in range(3000):
        kinds = "".join(rng.choice("suaoSUAOx" if rng.random() < 0.5 else "uaUx") for _ in range(rng.randrange(9)))
        assert earley.repair(kinds) == cheapest(kinds)


def test_pieces_are_the_whole():
    rng = random.Random(2)
    kinds = "".join(rng.choice("suaUAx") for _ in range(200))
    cost, audit, roles = earley.repair(kinds)
    for size in (1, 7, 64):
        parts = [kinds[k : k + size] for k in range(0, len(kinds), size)]
        behind, total, item, got = [earley.END], 0, earley.ROOT, ["", ""]
        for p in reversed(parts):
            more, front = earley.read(behind[-1], p)
            behind.append(front)
            total += more
        assert total + behind.pop()[earley.ROOT] == cost
        for k, p in enumerate(parts, 1):
            a, r, item = earley.write(item, behind.pop(), p, k == len(parts))
            got = [got[0] + a, got[1] + r]
        assert got == [audit, roles]


def test_sets_are_few():
    earley.step.cache_clear()
    rng = random.Random(3)
    earley.repair("".join(rng.choice("suaoSUAOx") for _ in range(20000)))
    assert earley.step.cache_info().currsize < 1000


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain(rows):
    hurt, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, kinds, n = set(), "", dict.fromkeys("bdt", 0)
        for _, _, role, text in own:
            said, core = (role, text), text.rstrip(" \t\n\x0b\f\r")
            fault = "b" if not core else "d" if said in seen else "t" if core[-1] not in ".!?" else ""
            seen.add(said)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
            if fault:
                n[fault] += 1
        cost, audit, roles = cheapest(kinds)
        left, lines = iter(own), []
        for a, r in zip(audit, roles, strict=True):
            row = next(left) if a != "I" else (0, 0, "", "")
            if a != "D":
                lines.append((row[2] if a == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + row[3])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        out.append((conv, gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(rows, **sizes):
    found = cr.repaired_conversations(rows, cr.repairs(cr.damaged(rows), **sizes))
    return sorted(map(tuple, found.collect()), key=repr)


def made(seed, convs, rows):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Well?", " ", "", "So!\n", "A é.", None, "And \t"]
    return [
        (rng.choice([None, 1, 2, 3, *range(convs)]), rng.choice([None, rng.randrange(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(40)}.")
        for _ in range(rows)
    ]


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 2}, {"piece_rows": 5, "piece_bytes": 9}])
def test_odd_rows(spark, sizes):
    rows = made(5, 12, 260)
    given = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS conv", "'x' AS kind")
    assert got(given, **sizes) == plain(rows)


def test_hot_conversation(spark):
    rows = [(7, k // 3, "user" if k % 2 else "assistant", f"Text {k % 400}.") for k in range(1500)] + [(8, 1, "user", "Same?")] * 700
    assert got(spark.createDataFrame(rows, SCHEMA), piece_rows=50) == plain_big(rows)


def plain_big(rows):
    """As plain(), the recursion replaced by the parser, which is held to it above."""
    kept = globals()["cheapest"]
    globals()["cheapest"] = earley.repair
    try:
        return plain(rows)
    finally:
        globals()["cheapest"] = kept


def test_empty_long_and_dropped(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (5, 1, "user", "long " * 300_000 + "."), (5, 2, "assistant", " " * 500_000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_against_sql(spark, sf_dir):
    check(cr.op13_conversation_repair(spark, sf_dir), connect(sf_dir), cr.ORACLE_SQL["op13_conversation_repair"])


def test_odd_rows_against_sql(spark, tmp_path):
    spark.createDataFrame(made(6, 12, 150), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    check(cr.op13_conversation_repair(spark, str(tmp_path)), con, cr.ORACLE_SQL["op13_conversation_repair"])


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, cr.op13_conversation_repair(spark, sf_dir).collect()), key=repr) == plain(rows)
