"""Media columns: payloads stored as 8-bit audio, in content-defined chunks, and read back.

A text's UTF-8 bytes, padded with spaces to whole frames, become the samples of an
8-bit mono WAV file. A rolling gear hash cuts the payload where its content says so,
within a least and a most length, so equal passages give equal chunks wherever they
stand. Chunk digests are counted by Spark; a chunk that occurs once stays in its own
row's chunk list, one that repeats is kept once in the chunk store and the lists name
its digest. Reading back joins the store to the lists, puts the chunks in order,
checks every digest, and decodes the file.

Which digests repeat is told to the tasks by a table of bits of fixed size (two bits a
digest). A chunk whose bits are set by chance goes to the store needlessly; with very
many repeating digests more chunks do, and all is still read back exactly.

Only lists with digests, and only one of each group of equal files, meet the store in
a shuffle; unique chunks move nowhere.

Defined results: a null text is an empty one; an empty payload is one frame of spaces;
repeated rows and equal texts give equal values; very long texts are cut and read back
whole; null and shared doc_ids work like any other; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

FRAME = 192
RATE = 8000
#: Least, average (a power of two) and most length of a chunk.
LEAST, AVERAGE, MOST = 512, 2048, 8192
#: Bytes that the gear hash spans: as many as it has bits.
SPAN = 32
#: log2 of the bits that tell repeating digests, and of those in one group: 16 MB broadcast.
BITS, GROUP = 27, 16
#: Bytes of texts, and rows, given to Spark at once, about; a longer text goes alone.
TOGETHER, ROWS = 1 << 23, 1000

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def padded(text: str | None) -> tuple[bytes, int]:
    """(payload, unpadded length)."""
    data = (text or "").encode()
    return data + b" " * (max(-(-len(data) // FRAME), 1) * FRAME - len(data)), len(data)


def wav_header(n: int) -> bytes:
    """The header of a WAV file of n 8-bit mono samples; n is even."""
    return _HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(file: bytes) -> bytes:
    """The samples of such a file; ValueError if it is not one."""
    riff, size, wave, fmt, fmt_size, pcm, channels, _, _, width, bits, data, n = _HEADER.unpack_from(file)
    if (riff, wave, fmt, data, fmt_size, pcm, channels, width, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 16, 1, 1, 1, 8):
        raise ValueError("not an 8-bit mono WAV file")
    if size != 36 + n or len(file) != 44 + n:
        raise ValueError("a WAV file of another length than its header says")
    return file[44:]


def _slices(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded bytes and rows; sizes: the bytes of each row, null for none."""
    first = size = 0
    for k, n in enumerate(sizes.to_pylist()):
        if k > first and (size + (n or 0) > TOGETHER or k - first == ROWS):
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n or 0
    if batch.num_rows:
        yield batch.slice(first)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(data)
    if n <= LEAST:
        return [n]
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < SPAN:  # after each step a hash spans twice as many bytes
        rolled[reach:] += rolled[:-reach] << np.uint32(reach)
        reach *= 2
    wanted = np.flatnonzero(rolled >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1
    ends, start, k = [], 0, 0
    wanted = wanted.tolist()
    while n - start > LEAST:
        while k < len(wanted) and wanted[k] < start + LEAST:
            k += 1
        end = min(wanted[k] if k < len(wanted) else n, start + MOST, n)
        ends.append(end)
        start = end
    return [*ends, n] if start < n else ends


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks of a payload, in order."""
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(hashlib.sha256(p).digest(), p) for p in parts]


def _slots(digest: bytes) -> tuple[int, int]:
    one, two = struct.unpack_from("<II", digest)
    return one >> (32 - BITS), two >> (32 - BITS)


def features(samples: bytes) -> str:
    """Of 8-bit samples: number, sum and energy about the middle, peak, and changes of sign."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max(initial=0)};turns={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"


def repeating(docs: DataFrame) -> np.ndarray:
    """The bits of the chunk digests that occur more than once."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(d for text in batch.column(0) for d, _ in chunks(padded(text.as_py())[0]))
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique([s for d in batch.column(0).to_pylist() for s in _slots(d)]).astype(np.int64)
            yield pa.record_batch([pa.array(slots >> GROUP), pa.array(slots & ((1 << GROUP) - 1))], ["part", "slot"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << GROUP, bool)
        on[rows["slot"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"][:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    counted = docs.select("text").mapInArrow(digests, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    slots = counted.where("n > 1").select("digest").mapInArrow(bits, "part long, slot long").distinct()
    table_ = np.zeros((1 << (BITS - GROUP), (1 << GROUP) // 8), np.uint8)
    for row in slots.groupBy("part").applyInPandas(packed, "part long, bits binary").collect():  # at most the table's size
        table_[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return table_.reshape(-1)


def _told(bits: np.ndarray, digest: bytes) -> bool:
    return all(bits[s >> 3] >> (s & 7) & 1 for s in _slots(digest))


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, store). media: doc_id, n_bytes, media_sha256, header and the chunk list, in order, of each row:
    digest, and data unless the store has it. store: digest, data. Both are written tables."""
    sent = docs.sparkSession.sparkContext.broadcast(repeating(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {d: p for text in batch.column(0) for d, p in chunks(padded(text.as_py())[0]) if _told(sent.value, d)}
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
        for whole in batches:
            for batch in _slices(whole, pc.binary_length(whole.column("text"))):
                sizes, digests, headers, lists, stores = [], [], [], [], []
                for text in batch.column("text"):
                    payload, n = padded(text.as_py())
                    header = wav_header(len(payload))
                    own = [(d, _told(sent.value, d), p) for d, p in chunks(payload)]
                    sizes.append(n)
                    headers.append(header)
                    digests.append(hashlib.sha256(header + payload).hexdigest())
                    lists.append([{"digest": d, "data": None if told else p} for d, told, p in own])
                    stores.append(any(told for _, told, _ in own))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(headers, pa.binary()), pa.array(stores, pa.bool_()), pa.array(lists, item)],
                    ["doc_id", "n_bytes", "media_sha256", "header", "in_store", "chunks"],
                )

    store = docs.select("text").mapInArrow(shared, "digest binary, data binary").dropDuplicates(["digest"])
    media = docs.select("doc_id", "text").mapInArrow(
        listed,
        f"doc_id {kind}, n_bytes long, media_sha256 string, header binary, in_store boolean, chunks array<struct<digest:binary,data:binary>>",
    )
    return cut(media, "media"), cut(store, "store")


def read_back(media: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256, header, chunks and parts: parts are the chunks from the store with their places."""
    refs = (
        media.where("in_store")
        .select("media_sha256", F.posexplode(F.transform("chunks", lambda c: F.when(c["data"].isNull(), c["digest"]))).alias("place", "digest"))
        .where("digest is not null")
        .distinct()  # equal files ask once
    )
    # Written, so that the join below stands by itself and Spark can split a group of very many equal files.
    parts = cut(refs.join(store, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("place", "data")).alias("parts")), "parts")
    names = ["doc_id", "n_bytes", "media_sha256", "header", "chunks"]
    alone = media.where(~F.col("in_store")).select(*names, F.array().cast("array<struct<place:int,data:binary>>").alias("parts"))
    return alone.unionByName(media.where("in_store").join(parts, "media_sha256").select(*names, "parts"))


def inspected(rows: DataFrame) -> DataFrame:
    """What read_back() gives, put together, verified and decoded, as the columns of the query."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, whole.column("n_bytes")):
                out = []
                for header, named, parts, said in zip(*(batch.column(n) for n in ("header", "chunks", "parts", "media_sha256")), strict=True):
                    fetched = {p["place"]: p["data"] for p in parts.as_py()}
                    data = []
                    for place, chunk in enumerate(named.as_py()):
                        part = chunk["data"] if chunk["data"] is not None else fetched[place]
                        if hashlib.sha256(part).digest() != chunk["digest"]:
                            raise ValueError(f"chunk {place} of {said.as_py()} has another digest")
                        data.append(part)
                    file = b"".join([header.as_py(), *data])
                    digest = hashlib.sha256(file).hexdigest()
                    if digest != said.as_py():
                        raise ValueError(f"{said.as_py()} is read back as {digest}")
                    samples = wav_samples(file)
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), digest, features(samples)))
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names]
                )

    return rows.mapInArrow(
        each, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as stored media, read back from its chunks."""
    return inspected(read_back(*stored(table(spark, sf_dir, "documents"))))


QUERIES = {"op6_media_chunks": op6_media_chunks}
ORACLE_SQL: dict[str, str] = {}
