import math

import duckdb
import numpy as np
import pytest
from oracle import check, connect
from pyspark.sql import functions as F

from tidewheel.llm import ball_tree as bt
from tidewheel.llm import hard_negatives as hn
from tidewheel.session import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    """By scoring every pair: the definition."""
    ok = [
        (i, [math.floor(256 * float(x)) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, v, label) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, own) for to, (j, w, own) in enumerate(ok) if to != at)
            for p, j, own in [s for s in scored if s[2] == label][:5]:
                hard = [(n, s) for s, n, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
                out += [(i, j, k + 1, n, -p, -s) for k, (n, s) in enumerate(hard)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def embeddings(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return con


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = got(hn.op12_hard_negatives(spark, sf_dir))
    assert found == plain(rows) and found


def test_against_sql(spark, sf_dir):
    check(hn.op12_hard_negatives(spark, sf_dir), connect(sf_dir), hn.ORACLE_SQL["op12_hard_negatives"])


@pytest.mark.parametrize("sizes", [{}, {"PART": 40, "SENT_BYTES": 2000, "ASKED": 3}])
def test_ties_repeats_and_small_parts(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(hn.planted, "__defaults__", (sizes.get("PART", hn.PART), hn.PART_BYTES))
    monkeypatch.setattr(hn.searched, "__defaults__", (sizes.get("SENT_BYTES", hn.SENT_BYTES),))
    monkeypatch.setattr(hn, "ASKED", sizes.get("ASKED", hn.ASKED))
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 900)), (rng.integers(-1, 3, 5) / 4).tolist(), int(rng.integers(0, 3))) for _ in range(500)]
    rows += [(300, [0.5] * 5, 1)] * 4 + [(k, [0.25] * 5, k % 2) for k in range(1000, 1200)]
    con = embeddings(spark, rows, tmp_path)
    query = hn.op12_hard_negatives(spark, str(tmp_path))
    assert got(query) == plain(rows)
    check(query, con, hn.ORACLE_SQL["op12_hard_negatives"])


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(None, [1.0], 1), (100, None, 1), (100, [None, 1.0], 1), (100, [1.0, 2.0], None), (1, [float("nan")], 1), (2, [float("inf")], 2)]
    rows += [(100 * k, rng.normal(0, 1, int(rng.choice([0, 1, 3, 6]))).tolist(), int(rng.integers(-12, 4))) for k in range(30)]
    rows += [(k, rng.normal(0, 1, 3).tolist(), k % 4) for k in range(200)]
    embeddings(spark, rows, tmp_path)
    clashing = table(spark, str(tmp_path), "embeddings").withColumns({"score": F.lit("x"), "row": F.lit(0), "query": F.lit(None)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = plain(rows)
    assert got(hn.mined(clashing, F.col("id") % 100 == 0, label)) == want and want
    assert got(hn.mined(clashing.limit(0), F.col("id") % 100 == 0, label)) == []
    assert got(hn.mined(clashing.where("label = 1"), F.col("id") % 100 == 0, F.col("label"))) == []


def test_trees_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (40, 16))
    weights = np.concatenate([c + rng.normal(0, 3, (100, 16)) for c in centres]).astype(np.int64)
    labels = np.repeat(np.arange(40) % 4, 100)
    ids = rng.permutation(4000)
    tree = bt.build(ids, np.arange(4000), labels, weights)
    low, high = bt.bounds(tree, weights[:50])
    for node, (begin, end, *_) in enumerate(tree.nodes):
        scores = weights[:50] @ tree.weights[begin:end].T
        assert (scores.min(1) >= low[:, node]).all() and (scores.max(1) <= high[:, node]).all()
    own = weights[::100]
    top = (own * own).sum(1)
    asked = bt.Queries(own, np.arange(0, 4000, 100), labels[::100], top * 3 // 10, top * 9 // 10)
    for same in (True, False):
        best = bt.Best(len(own), 10)
        scored = bt.search(tree, asked, best, same)
        assert scored < len(own) * 4000 / 2
        for q in range(len(own)):
            s = weights @ own[q]
            ok = (s >= asked.least[q]) & (s <= asked.most[q]) & ((labels == asked.labels[q]) == same) & (np.arange(4000) != asked.rows[q])
            want = sorted(zip(-s[ok], ids[ok], strict=True))[:10]
            assert [(-a, b) for a, b in zip(best.score[q], best.id[q], strict=True) if b != bt.NOBODY] == want
