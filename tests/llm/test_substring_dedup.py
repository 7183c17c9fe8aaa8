import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import substring_dedup
from tidewheel.session import table


def plain(rows, window=35):
    """[(doc_id, text)] -> sorted [(doc_id, n_words, n_removed, kept)]."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(docs, **params):
    return sorted(map(tuple, substring_dedup.remove_repeats(docs, **params).select("doc_id", "n_words", "n_removed", "text").collect()), key=repr)


@pytest.mark.parametrize(("cells", "hot"), [(None, substring_dedup.HOT), (1 << 16, 3), (None, 2), (1, 50)])
def test_documents(spark, sf_dir, monkeypatch, cells, hot):
    if hot < substring_dedup.HOT:  # so small that a window may have more rows
        monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    docs = table(spark, sf_dir, "documents")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substring_dedup.suspects(docs, cells=cells, hot=hot)[1] == (hot < substring_dedup.HOT)
    assert got(docs, cells=cells, hot=hot) == want


def test_a_window_in_every_document_is_spread(spark, monkeypatch):
    """Every piece holds one document, and all share a window: no task gets over twice the median of its rows."""
    monkeypatch.setattr(substring_dedup, "PIECE", 1)
    line = " ".join(f"w{i}" for i in range(35))
    rows = [(i, f"a{i} {line} b{i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.select(F.lit(1).cast("long").alias("one"), F.lit(2).alias("two"), "doc_id", F.xxhash64("text").alias("text_key"), F.hash("text").alias("text_hash"), F.lit(64).alias("span"), F.lit(False).alias("known"))
    salted = substring_dedup._hot(found)
    assert salted.count() == 2000
    spread = [r["n"] for r in found.groupBy(F.pmod(F.xxhash64("text_key", "span"), F.lit(substring_dedup.SALTS)).alias("s")).agg(F.count("*").alias("n")).collect()]
    assert len(spread) == substring_dedup.SALTS and max(spread) <= 2 * sorted(spread)[len(spread) // 2]
    assert got(docs, hot=100) == plain(rows)


def test_what_the_sketch_passes(spark, sf_dir):
    """Few more windows than share an anchor; all of them where every anchor has the same cell."""
    docs = table(spark, sf_dir, "documents")
    anchors, places = Counter(), Counter()
    for r in docs.collect():
        piece = substring_dedup.Piece([(r["text"] or "").encode().split()], 35, 20)
        anchors.update(piece.runs[piece.anchor_at].tolist())
        places.update(piece.runs[piece.anchor_places()].tolist())
    least = sum(n for a, n in anchors.items() if places[a] > 1)
    windows = F.sum(F.col("span") % substring_dedup.SPAN + 1)
    passed = substring_dedup.suspects(docs)[0].agg(windows).first()[0]
    assert least <= passed <= least + 0.05 * sum(anchors.values())
    assert substring_dedup.suspects(docs, cells=1)[0].agg(windows).first()[0] == sum(anchors.values())


def test_cells_grow_with_the_text():
    for size in (0, 10**6, 10**9, 10**12, 10**14):
        assert size <= substring_dedup.cells_for(size) <= max(2 * size, substring_dedup.CELLS[0])


def test_null_and_shared_ids_with_equal_hashes(spark, monkeypatch):
    """Texts of one id, or of none, whose 32-bit hashes are equal stay apart."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{passage} end"), (None, "short"), (7, f"x {passage}"), (7, "one two"), (None, None), (7, "")]
    real = substring_dedup._hashed
    monkeypatch.setattr(substring_dedup, "_hashed", lambda d: real(d).withColumn("text_hash", F.lit(0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == plain(rows)


def test_digest(spark, sf_dir):
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain([(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()])}
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op2_substring_dedup(spark, sf_dir).collect()}
    assert found == want


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, window=6, anchor=3) == plain(rows, 6)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, passage), (2, f"x {passage}\ty é"), (3, None), (4, ""), (5, "a " * 20_000), (None, f"{passage} z"),
        (6, " ".join(f"v{i}" for i in range(50))), (6, " ".join(f"v{i}" for i in range(50))), (7, " ".join(f"u{i}" for i in range(36))), (7, "other text"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)})
    assert got(docs) == plain(rows)
    assert got(docs.limit(0)) == []
