"""Language-model scores of texts by a log-bilinear neural model over words.

Tokens are the words, in ASCII lower case, and one end a text. The HEAD most frequent words
are classes of their own, other words share SHARED classes by their endings, as words to be
predicted and as context; their number is bounded since probabilities are normalised over
every pair of context classes once. The model
(log_bilinear.py) gives the class after the two before it; within a shared class a word
has its add-one share, with one more share for all words never seen. A text's score is
the sum of log10 probabilities over its tokens, normalised over all words.

All training texts count, and each is trained on once. Tasks write every text as
numbers into their piece's own dictionary, so a word goes to the count once a piece,
not once an occurrence; counts come back to the pieces by the same key. Neither a word
that is everywhere nor a vocabulary that grows with the corpus meets in one task or in
the driver. Training runs in rounds, and in chains of about CHAIN tokens: a text's round
and chain follow from a hash of it and its doc_id, every chain trains in the order of that
hash from the round's weights, and weights are averaged by tokens, a level of chains at a
time. So scores depend on the rows and not on how they are partitioned. Texts whose hash
has very many rows (copies under one doc_id, or under none) are spread over the chains.

Defined results: a null text is empty and has its end alone; without any training text
the counts are zero and every token has probability 1 in the base score; equally frequent
words take classes in code point order; repeated rows are counted and scored each; very
long texts are scored whole; a null doc_id is not held out; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import log_bilinear as lb
from tidewheel.session import table
from tidewheel.storage import cut

#: Words with classes of their own, shared classes, and characters of a word's ending.
HEAD, SHARED, ENDING = 1792, 256, 2
ROUNDS = 4
#: Tokens of a piece, about: what has one dictionary.
PIECE = 1 << 21
#: Tokens of a chain, about; chains averaged together; rows of one hash above which they are spread.
CHAIN, TOGETHER, HOT = 1 << 20, 64, 1 << 10
#: The end of a text as a word; no word holds a line break.
END = "\n"


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def numbered(docs: DataFrame) -> DataFrame:
    """Texts as numbers into dictionaries, a dictionary for each piece; from (doc_id, held_out, text).

    Rows with ids are texts: piece, doc_id, held_out, ids. The others are dictionary
    entries: piece, number, word, n (occurrences in training texts).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        id_type = None

        def rows(texts, place) -> Iterator[pa.RecordBatch]:
            n, k = len(place), len(texts)
            count = np.zeros(n, np.int64)
            for _, out, ids in texts:
                if not out:
                    np.add.at(count, np.frombuffer(ids, np.uint32), 1)
            words = pa.array([END.encode() if w is None else w for w in place], pa.binary()).cast(pa.string())
            columns = [
                pa.array(np.full(k + n, own)),
                pa.array([t[0] for t in texts] + [None] * n, id_type),
                pa.array([t[1] for t in texts] + [None] * n, pa.bool_()),
                pa.array([t[2] for t in texts] + [None] * n, pa.binary()),
                pa.array(np.r_[np.zeros(k, np.int32), np.arange(n, dtype=np.int32)], mask=np.r_[np.ones(k, bool), np.zeros(n, bool)]),
                pa.concat_arrays([pa.nulls(k, pa.string()), words]),
                pa.array(np.r_[np.zeros(k, np.int64), count], mask=np.r_[np.ones(k, bool), np.zeros(n, bool)]),
            ]
            yield pa.record_batch(columns, ["piece", "doc_id", "held_out", "ids", "number", "word", "n"])

        texts, place, size = [], {None: 0}, 0
        for batch in batches:
            id_type = batch.column("doc_id").type
            for i, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").lower().split()
                ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.uint32, len(words))
                texts.append((i, out, np.r_[ids, np.uint32(0)].astype(np.uint32).tobytes()))
                size += len(words) + 1
                if size >= PIECE:
                    yield from rows(texts, place)
                    texts, place, size, own = [], {None: 0}, 0, own + 1
        if texts:
            yield from rows(texts, place)

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        each, f"piece long, doc_id {kind}, held_out boolean, ids binary, number int, word string, n long"
    )


def _shared_class(word: Column, head: int, shared: int) -> Column:
    return (F.pmod(F.crc32(F.substring(word, -ENDING, ENDING)), F.lit(shared)) + head).cast("int")


class Counts:
    """Numbers of the training texts: tokens, distinct words, and for each class its tokens and distinct words."""

    def __init__(self, tokens: int, distinct: int, head: int, shared: int, classes: dict[int, tuple[int, int]]):
        self.tokens, self.distinct, self.head, self.classes = tokens, distinct, head, head + shared
        self.n = np.array([classes.get(k, (0, 0))[0] for k in range(self.classes)], np.int64)
        self.v = np.array([classes.get(k, (0, 0))[1] for k in range(self.classes)], np.int64)

    def frequency(self) -> np.ndarray:
        return (self.n + 1) / (self.n + 1).sum()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + 1 * (self.distinct + 1)))

    def inside(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 probability of a word within its class; a class of one word gives 0."""
        return np.where(k < self.head, 0.0, np.log10((c + 1) / (self.n[k] + self.v[k] + 1)))


def counted(rows: DataFrame, head: int = HEAD, shared: int = SHARED) -> tuple[DataFrame, Counts]:
    """((word, c, class) of all words in training texts, Counts)."""
    spark = rows.sparkSession
    words = cut(rows.where("number is not null").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    top = [(r["word"], k) for k, r in enumerate(words.orderBy(F.desc("c"), "word").limit(head).collect())]
    own = spark.createDataFrame(top, "word string, own int")
    classed = words.join(F.broadcast(own), "word", "left")  # own: a row for each class of one word
    classed = classed.select("word", "c", F.coalesce("own", _shared_class(F.col("word"), len(top), shared)).alias("class"))
    found = {r["class"]: (r["n"], r["v"]) for r in classed.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    return classed, Counts(sum(n for n, _ in found.values()), sum(v for _, v in found.values()), len(top), shared, found)


def classified(rows: DataFrame, words: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, inside_score and classes (16 bits a token) of each text."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)
    own = rows.where("number is not null").select(F.col("piece").alias("of_piece"), "number", "word")
    entries = own.join(words, "word", "left").select(
        "of_piece", "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", _shared_class(F.col("word"), counts.head, counts.classes - counts.head)).alias("class")
    )
    texts = rows.where("ids is not null").select("piece", "doc_id", "held_out", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("number")
        c, k = entries["c"].to_numpy(np.int64), entries["class"].to_numpy(np.int64)
        base, inside, known = sent.value.base(c), sent.value.inside(c, k), c > 0
        out = []
        for ids in texts["ids"]:
            ids = np.frombuffer(ids, np.uint32)
            out.append((len(ids), int(known[ids].sum()), base[ids].sum(), inside[ids].sum(), k[ids].astype("<u2").tobytes()))
        columns = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "inside_score", "classes"])
        return pd.concat([texts[["doc_id", "held_out"]].reset_index(drop=True), columns], axis=1)

    return (
        texts.groupBy("piece")
        .cogroup(entries.groupBy("of_piece"))
        .applyInPandas(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inside_score double, classes binary")
    )


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in column]


def _dealt(training: DataFrame, rounds: int, chains: int) -> DataFrame:
    """(round, chain, h, classes): where each training text is trained on, and when."""
    rows = training.withColumn("h", F.xxhash64("classes", "doc_id"))
    often = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot")
    if not often.isEmpty():
        salt = F.when(F.col("n").isNotNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(0)
        rows = rows.join(often, "h", "left").withColumn("h", F.col("h").bitwiseXOR(salt))
    return rows.select(F.pmod("h", F.lit(rounds)).alias("round"), F.pmod(F.xxhash64("h"), F.lit(chains)).alias("chain"), "h", "classes")


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    total, tokens = np.zeros(1), rows["tokens"].sum()
    for n, w in zip(rows["tokens"], rows["weights"], strict=True):
        total = total + n / tokens * np.frombuffer(w, np.float32)
    return pd.DataFrame({"part": rows["part"][:1] // TOGETHER, "tokens": [tokens], "weights": [total.astype(np.float32).tobytes()]})


def _chain(sent, turn: int, classes: int, frequency: np.ndarray, size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What trains the weights that were sent on the texts of one chain."""

    def local(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "classes"])
        number = int(own["chain"].iloc[0])
        mine = lb.Weights.unpack(sent.value, classes, size)
        a, b, w = lb.contexts([np.frombuffer(x, "<u2") for x in own["classes"]], classes)
        lb.train(mine, a, b, w, frequency, np.random.default_rng([turn, number]))
        return pd.DataFrame({"part": [number], "tokens": [len(w)], "weights": [mine.pack()]})

    return local


def trained(texts: DataFrame, counts: Counts, rounds: int = ROUNDS, size: int = lb.SIZE) -> lb.Weights:
    """Weights trained on classified training texts, each in one of the rounds."""
    spark = texts.sparkSession
    classes, frequency = counts.classes, counts.frequency()
    weights = lb.start(frequency, size)
    chains = max(1, -(-counts.tokens // (max(rounds, 1) * CHAIN)))
    training = _dealt(texts.where(~F.col("held_out")).select("doc_id", "classes"), rounds, chains) if rounds else None
    schema = "part long, tokens long, weights binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights.pack())
        local = _chain(sent, turn, classes, frequency, size)
        means = training.where(F.col("round") == turn).select("chain", "h", "classes").groupBy("chain").applyInPandas(local, schema)
        left = chains
        while left > 1:
            means, left = means.groupBy((F.col("part") / TOGETHER).cast("long").alias("to")).applyInPandas(_mean, schema), -(-left // TOGETHER)
        found = means.toPandas()  # one row
        if len(found):
            weights = lb.Weights.unpack(found["weights"][0], classes, size)
    return weights


def all_totals(spark: SparkSession, weights: lb.Weights, counts: Counts, size: int = lb.SIZE) -> np.ndarray:
    """log_totals of every pair of classes, computed by Spark; as many as the classes squared."""
    n = counts.classes + 1
    sent = spark.sparkContext.broadcast(weights.pack())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lb.Weights.unpack(sent.value, n - 1, size)
        for batch in batches:
            for a in batch.column(0).to_pylist():
                totals = lb.log_totals(own, np.full(n, a), np.arange(n)).astype(np.float32)
                yield pa.record_batch([pa.array([a]), pa.array([totals.tobytes()], pa.binary())], ["a", "totals"])

    rows = sorted(spark.range(n).mapInArrow(each, "a long, totals binary").collect())
    return np.concatenate([np.frombuffer(r["totals"], np.float32) for r in rows])


def scored(docs: DataFrame, head: int = HEAD, shared: int = SHARED, rounds: int = ROUNDS, size: int = lb.SIZE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; from (doc_id, held_out, text)."""
    spark = docs.sparkSession
    rows = cut(numbered(docs), "numbered")
    words, counts = counted(rows, head, shared)
    texts = cut(classified(rows, words, counts), "classified")
    weights = trained(texts, counts, rounds, size)
    sent = spark.sparkContext.broadcast((weights.pack(), all_totals(spark, weights, counts, size)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lb.Weights.unpack(sent.value[0], counts.classes, size)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                classes = _texts(batch.column("classes"))
                a, b, w = lb.contexts(classes, counts.classes)
                first = np.cumsum([0, *(len(t) for t in classes[:-1])])
                logs = np.add.reduceat(lb.log_chances(own, a, b, w, sent.value[1]), first) / np.log(10)
                score = logs + batch.column("inside_score").to_numpy()
                yield pa.record_batch(
                    [*(batch.column(c) for c in names), pa.array(np.full(batch.num_rows, counts.tokens)), pa.array(score)], [*names, "train_tokens", "score"]
                )

    out = texts.mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those not held out."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text"))


QUERIES = {"op7_log_bilinear": op7_log_bilinear}
ORACLE_SQL: dict[str, str] = {}
