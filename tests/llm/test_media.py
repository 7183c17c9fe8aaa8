import hashlib
import io
import random
import wave
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import media
from tidewheel.session import table


def plain_cuts(data):
    """The same cuts, a byte at a time."""
    ends, start = [], 0
    while len(data) - start > media.LEAST:
        for i in range(start + media.LEAST - 1, len(data)):
            h = sum(int(media._GEAR[data[i - j]]) << j for j in range(min(media.SPAN, i + 1))) % 2**32
            if h >> (32 - media.AVERAGE.bit_length() + 1) == 0 or i + 1 - start == media.MOST:
                break
        ends.append(i + 1)
        start = i + 1
    return [*ends, len(data)] if start < len(data) else ends


@pytest.mark.parametrize("n", [192, 512, 513, 3000, 40_000])
def test_cuts(n):
    data = random.Random(n).randbytes(n)
    assert media.cuts(data) == plain_cuts(data)
    assert media.cuts(b" " * n)[-1] == n


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    passage = rng.randbytes(40_000)
    one, two = ({d for d, _ in media.chunks(rng.randbytes(k) + passage)} for k in (1_000, 7_777))
    assert len(one & two) > 10


def expected(text):
    data = (text or "").encode()
    payload = data.ljust(max(-(-len(data) // 192), 1) * 192)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(media.RATE)
        w.writeframes(payload)
    file = out.getvalue()
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), media.features(payload))


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_documents(spark, sf_dir):
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in media.op6_media_chunks(spark, sf_dir).collect()}
    assert found == {r["doc_id"]: expected(r["text"]) for r in table(spark, sf_dir, "documents").collect()}


def test_chunks_are_stored_once(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, store = media.stored(docs.union(docs))
    assert rows.where(F.exists("chunks", lambda c: c["data"].isNotNull())).count() == 0
    assert store.count() == store.select("digest").distinct().count()


def test_a_damaged_store_is_noticed(spark):
    docs = spark.createDataFrame([(1, "abc " * 500), (2, "abc " * 500)], "doc_id long, text string")
    rows, store = media.stored(docs)
    bad = store.withColumn("data", F.lit(b"x"))
    with pytest.raises(Exception, match="another digest"):
        media.inspected(media.read_back(rows, bad)).collect()


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(media, "TOGETHER", 100)
    monkeypatch.setattr(media, "ROWS", 4)
    sizes = [60, 30, 20, None, 500, 1, 1, 1, 1, 1, 99, 2]
    batch = pa.record_batch([pa.array(range(len(sizes)))], ["n"])
    parts = [p.column(0).to_pylist() for p in media._slices(batch, pa.array(sizes))]
    assert sum(parts, []) == list(range(len(sizes)))
    assert all(len(p) <= 4 and (len(p) == 1 or sum(sizes[k] or 0 for k in p) <= 100) for p in parts)
    assert list(media._slices(batch.slice(0, 0), pa.array([], pa.int64()))) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "long text " * 50_000), (None, "x"), (4, "long text " * 50_000), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("clash"), "chunks": F.lit(0)})
    found = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in media.inspected(media.read_back(*media.stored(docs))).collect()), key=repr)
    assert found == sorted(((i, *expected(t)) for i, t in rows), key=repr)
    assert media.inspected(media.read_back(*media.stored(docs.limit(0)))).count() == 0
