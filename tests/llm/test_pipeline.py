from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_packing import EXACT
from test_wide_prints import plain_groups

from tidewheel.llm import language_id
from tidewheel.session import table
from tidewheel.storage import cut


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents")]
    for _, stage in cp.STAGES:
        docs.append(cut(stage(spark, docs[-1], sf_dir), "test"))
    return docs


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    gone = set(before) - set(after)
    assert all(after[i] == before[i] for i in after)
    assert len(gone) <= 0.02 * len(before)
    assert all(any(c.isalpha() for c in r["text"]) for r in after.values())


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    want = set(plain_groups({i: r["text"] for i, r in before.items()}).values())
    assert set(after) == want and stages[2].count() == len(want)
    assert all(after[i] == before[i] for i in after)


def test_private_data_goes(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    assert not any("@mail" in r["text"] for r in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_mix_and_packing(stages):
    before = by_id(stages[3])
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    tokens = {i: len(EXACT.encode(before[i]["text"], add_special_tokens=False).ids) + 1 for i in copies}
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: n * tokens[i] for i, n in copies.items()}
    per = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in per)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert Counter(map(tuple, cp.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == Counter(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "123 !", "de", None), (4, "the cat sat", "en", "a"), (4, "the cat sat", "en", "a"), (5, "der hund lief", "de", None), (6, "w " * 20_000, None, "b")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        kept = given
        for name, stage in cp.STAGES:
            kept = cut(stage(spark, kept, sf_dir), "odd")
            if name == "language_id" and given is docs:
                assert sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6]
            if name == "near_dedup" and given is docs:
                assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert language_id.UNKNOWN == "und"


def test_columns_of_any_name_stay(spark, sf_dir):
    names = ["node", "score", "lang_pred", "entities", "n_entities", "target", "order_key", "row", "piece", "spans_"]
    rows = [(i, f"the cat {i} sat on mat {i} at 12.13.14.{i}", "en", "a", 30) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in names})
    for name, stage in cp.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "names")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert docs.count() and all(r[n] == n for r in docs.collect() for n in names), name
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
