import math

import duckdb
import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from tidewheel.llm import topk_search as tk
from tidewheel.session import table


def plain(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(ok):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for to, (j, w) in enumerate(ok) if to != at)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    assert got(tk.op3_topk_blocks(spark, sf_dir)) == plain(rows)


@pytest.mark.parametrize("turn", [1 << 14, 3])
def test_ties_and_turns(spark, monkeypatch, turn):
    monkeypatch.setattr(tk, "TURN", turn)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(400)] + [(i, [1.0] * 6) for i in range(400, 700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(tk.nearest(vectors, F.col("id") % 50 == 0)) == plain(rows)


def test_bounds_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (20, 16))
    blocks = [(np.arange(64) + 64 * i, (c + rng.normal(0, 3, (64, 16))).astype(np.int64)) for i, c in enumerate(centres)]
    queries = np.stack([w[0] for _, w in blocks])
    own = np.array([ids[0] for ids, _ in blocks])
    best, scored = tk.search(queries, own, np.full(20, tk.NONE), [(ids, ids, w) for ids, w in blocks], 5)
    ids, all_ = np.concatenate([i for i, _ in blocks]), np.concatenate([w for _, w in blocks])
    for q in range(20):
        s = all_ @ queries[q]
        want = sorted((-x, i) for x, i in zip(s, ids, strict=True) if i != own[q])[:5]
        assert [(-s, i) for s, i in zip(best.score[q], best.id[q], strict=True)] == want
    assert scored < 20 * 20 / 2


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.2, 0.1]), (None, [1.0, 1.0]), (50, [-1.0, 0.3]), (100, [2.0]), (7, [0.5, -1.0, 3.0]), (150, []), (200, [0.5, 1.0, 2.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "terms": F.lit(0)})
    assert got(tk.nearest(vectors, F.col("id") % 50 == 0)) == plain(rows)
    assert tk.nearest(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_unequal_lengths_against_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, int(rng.choice([2, 2, 2, 3, 5, 0]))).tolist()) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    check(tk.op3_topk_blocks(spark, str(tmp_path)), con, tk.ORACLE_SQL["op3_topk_blocks"])


def test_repeated_queries_against_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 60)), rng.normal(0, 1, 4).tolist()) for _ in range(200)] + [(50, [1.0] * 4)] * 3
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    check(tk.op3_topk_blocks(spark, str(tmp_path)), con, tk.ORACLE_SQL["op3_topk_blocks"])
    assert got(tk.op3_topk_blocks(spark, str(tmp_path))) == plain([tuple(r) for r in table(spark, str(tmp_path), "embeddings").collect()])
