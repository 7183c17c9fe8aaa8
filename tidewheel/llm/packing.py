"""Packing documents into training sequences of fixed length.

Every document is its token ids and an end id. Documents longer than a sequence are
cut into pieces of full length, the first piece taking the remainder, so that only
the number of pieces of each length matters: a histogram no longer than a sequence.
The configuration linear program over that histogram (configurations.py) says how many
sequences of which lengths to make. Pieces then find their place by rank among those
of their length: ranks are counted in salted groups and the groups' own counts, and a
length's ranks map to intervals of sequences.

The histogram and the plan are bounded by the sequence length and are broadcast; the
pieces are a written table and never meet in one task.

Defined results: a null text is empty and packs its end id alone; repeated rows are
packed each; pieces that tie in rank take any order; null and shared doc_ids work like
any other; very long texts are encoded whole and cut; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.configurations import pack
from tidewheel.session import table
from tidewheel.storage import cut

CAPACITY = 2048
END = 0
#: Ranked groups of a length: the square root of the number of pieces over this.
SPREAD = 16
#: Texts of these characters only are split alike by both tokenizer libraries, which is tested.
_FAR = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


@cache
def _encoders(vocabulary: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(vocabulary)), fast


def token_ids(text: str, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """Ids by the vocabulary, without special tokens added.

    The vocabulary's rank file gives the same ids several times faster; texts with other
    than Latin characters, or with a special token's name, go to the vocabulary's own library.
    """
    exact, fast = _encoders(vocabulary, ranks)
    if _FAR.search(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, encode=token_ids) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) % capacity or capacity
                for k, begin in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[begin : first + k * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of a length go, by rank: intervals of sequences and the offset in them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        sequences, intervals = 0, []
        left = dict.fromkeys(counts, 0)
        full = counts.get(capacity, 0)
        groups = pack({n: k for n, k in counts.items() if n < capacity}, capacity)
        for number, held in [*groups, *([(full, (capacity,))] if full else [])]:
            offset = 0
            for length in held:
                intervals.append((length, left[length], sequences, offset))
                left[length] += number
                offset += length
            sequences += number
        self.sequences = sequences
        table_ = np.array(sorted(intervals), np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = table_.T
        lengths, first = np.unique(self.length, return_index=True)
        self.span = {int(n): (a, b) for n, a, b in zip(lengths, first, np.append(first, len(self.length))[1:], strict=True)}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and rank."""
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            a, b = self.span[int(n)]
            at[mine] = a + np.searchsorted(self.rank[a:b], rank[mine], "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, encode=token_ids) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    salted = cut(
        pieces(docs, capacity, end, encode).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    salts = max(1, isqrt(salted.count()) // SPREAD)
    # By row, so that equal pieces are dealt to all groups of their length.
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut(groups.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "groups")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    inside = Window.partitionBy("length", "salt").orderBy("row")
    ranked = (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(groups, ["length", "salt"])
        .withColumn("rank", F.col("ahead") + F.col("inside"))
        .drop("ahead", "inside", "n", "salt")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(put, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing_lp": op4_packing_lp}
ORACLE_SQL: dict[str, str] = {}
