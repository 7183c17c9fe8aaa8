import corpus_pipeline as cp
from test_wide_prints import SHAPE


def test_null_and_shared_ids_join_no_texts(spark, sf_dir):
    texts = [" ".join(f"t{k}w{i}" for i in range(20)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (1, texts[4]), (8, texts[4]), (8, texts[5]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SHAPE)
    kept = cp.drop_near_duplicates(spark, docs, sf_dir).collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (1, texts[4]), (8, texts[5])]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for i, t in want)
